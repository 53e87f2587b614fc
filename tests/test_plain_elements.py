"""Elements that say no more than their ids are never sorted; the others keep their first writer."""

from trialgauge.operators import graph as g
from trialgauge.plans.staging import PIECE_BYTES, pieces_of

SAFETY = (
    "discrepancy_id string, study_id string, country string, site string, patient_id string, form_name string, created string, "
    "review_status string, action_status string, row_ord string"
)
PAGES = (
    "study_name string, country string, sitenumber string, subjectname string, foldername string, formname string, visit_date string, "
    "days_missing double, row_ord string"
)


def _safety(spark):
    rows = [(f"D{n}", "S1", "IT", f"X{n % 3}", f"P{n % 5}", "F", "2001", "Pending", "Pending", f"{n:04d}") for n in range(60)]
    return g.from_safety(spark.createDataFrame(rows, SAFETY))


def test_plain_elements_are_hashed(spark, capsys):
    source = _safety(spark)
    plain = g.first_writer([g.Source(source.rows, source.elements)])
    plain.explain()
    shown = capsys.readouterr().out
    assert "HashAggregate" in shown and "SortAggregate" not in shown
    found = {(r["src"], r["dst"]): r for r in plain.collect()}
    assert len(found) == 1 + 1 + 3 + 5 + 5 + 3 + 15 + 3 == plain.count()
    assert found["SITE:X1", ""]["props"] == {"site_id": "X1"} and found["SUBJECT:P1", "STUDY:S1"]["type"] == "ENROLLED_IN"


def test_first_source_wins_over_a_plain_writer(spark):
    issues = spark.createDataFrame([("S1", "P1", 7, "P1"), ("S1", "P9", 2, "P9")], "study string, subject string, total_open_issue_count_per_subject long, row_ord string")
    for order, counted in (((0, 1), {"P1", "P9"}), ((1, 0), {"P9"})):
        sources = [g.from_issues(issues), _safety(spark)]
        nodes, _ = g.build([sources[i] for i in order])
        subjects = nodes.where("node_type = 'Subject'").collect()
        assert len(subjects) == 6
        assert {r["props"]["subject_id"] for r in subjects if "open_issue_count" in r["props"]} == counted


def test_forms_and_pages_keep_their_first_row(spark):
    # a form of a row without a visit is not written; colons make one id of two forms, the earlier of which wins
    rows = [("A", "IT", "X", "P", "V", "B:C", "2002", 5.0, "0002"), ("A:B", "IT", "X", "P", "V", "C", "2001", 9.0, "0001"), ("A", "IT", "X", "P", None, "Z", "2000", 1.0, "0000")]
    nodes, _ = g.build([g.from_missing_pages(spark.createDataFrame(rows, PAGES))], pieces=3)
    props = {r["id"]: r["props"] for r in nodes.collect()}
    assert props["FORM:A:B:C"] == {"form_name": "C"} and "FORM:A:Z" not in props
    assert props["MISSING:A:P:V:B:C"] == {"days_missing": "5.0"} and props["COUNTRY:IT"] == {"country_code": "IT"}


def test_pieces_follow_the_size_of_the_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"0")
    few = pieces_of(spark, [str(tmp_path)])
    with open(tmp_path / "b", "wb") as f:
        f.truncate(PIECE_BYTES * (few + 6))
    assert pieces_of(spark, [str(tmp_path)]) == few + 7
