"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import joins as jn
from ..operators.exploration import outer_on_study
from ..plans import clinical_views as cv
from ..plans import features as ft
from .book import Book
from .graphs import _graph

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add(
    "j01_first_site_lookup",
    "SELECT e.subject, l.site, total_open_issue_count_per_subject AS issue_count FROM v_edrr e LEFT JOIN q_lookup l ON e.subject = l.subject",
)
def j01(spark, sf_dir):
    return jn.lookup_site(ft.view_issues(spark, sf_dir), ft.subject_sites(ft.view_enrolment(spark, sf_dir)))


@book.add(
    "j02_full_outer_on_study",
    "SELECT study, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM (SELECT study, count(*) AS a FROM v_edrr GROUP BY study) x "
    "FULL JOIN (SELECT study, count(*) AS b FROM v_meddra WHERE study <> 'Study 2' GROUP BY study) y USING (study) "
    "FULL JOIN (SELECT study_id AS study, count(*) AS c FROM v_esae WHERE study_id <> 'Study 3' GROUP BY study_id) z USING (study)",
)
def j02(spark, sf_dir):
    n = lambda df, name: df.groupBy("study").agg(F.count(F.lit(1)).alias(name))
    safety = cv.safety(spark, sf_dir, ["study_id"]).toDF("study")
    return outer_on_study(
        n(cv.issues(spark, sf_dir), "a"),
        n(cv.meddra(spark, sf_dir, ["study"]).where("study <> 'Study 2'"), "b"),
        n(safety.where("study <> 'Study 3'"), "c"),
    )


@book.add(
    "j03_semi_join",
    "SELECT count(*) AS subjects, CAST(sum(total_open_issue_count_per_subject) AS BIGINT) AS issues FROM v_edrr WHERE subject IN (SELECT patient_id FROM v_esae WHERE site = 'Site 1')",
)
def j03(spark, sf_dir):
    members = cv.safety(spark, sf_dir, ["site", "patient_id"]).where(F.col("site") == "Site 1")
    kept = ft.view_issues(spark, sf_dir).join(members.select(F.col("patient_id").alias("subject")), "subject", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("subjects"), F.sum("issue_count").alias("issues"))


@book.add(
    "j04_one_hop",
    "SELECT edge_type, count(*) AS n FROM q_both JOIN q_nodes ON node = id WHERE node_type = 'Site' GROUP BY edge_type",
)
def j04(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = g.by_type(nodes, "Site").select(F.col("id").alias("node"))
    return jn.one_hop(start, edges).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@book.add(
    "j05_two_hop",
    "SELECT b.neighbour AS target, count(*) AS n FROM q_nodes JOIN q_both a ON a.node = id AND a.edge_type = 'HAS_DISCREPANCY' "
    "JOIN q_both b ON b.node = a.neighbour AND b.edge_type = 'ENROLLED_AT' WHERE node_type = 'SafetyDiscrepancy' GROUP BY 1",
)
def j05(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    start = g.by_type(nodes, "SafetyDiscrepancy").select(F.col("id").alias("node"))
    return jn.two_hop(start, edges, "HAS_DISCREPANCY", "ENROLLED_AT").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


_HOPS = {
    "q_jhop0": "SELECT id, id AS target FROM q_nodes WHERE node_type = 'Country'",
    "q_jhop1": "SELECT neighbour AS id, min(target) AS target FROM q_both JOIN q_jhop0 ON node = q_jhop0.id WHERE neighbour NOT IN (SELECT id FROM q_jhop0) GROUP BY 1",
    "q_jhop2": "SELECT neighbour AS id, min(target) AS target FROM q_both JOIN q_jhop1 ON node = q_jhop1.id WHERE neighbour NOT IN (SELECT id FROM q_jhop0 UNION ALL SELECT id FROM q_jhop1) GROUP BY 1",
}


@book.add(
    "j06_nearest_target",
    "SELECT *, 0 AS hops FROM q_jhop0 UNION ALL SELECT *, 1 FROM q_jhop1 UNION ALL SELECT *, 2 FROM q_jhop2",
    **_HOPS,
)
def j06(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return g.nearest_targets(nodes, edges, "Country", max_hops=2)


@book.add(
    "j07_site_with_baseline",
    "SELECT f.entity_id AS site_id, f.metric, round(f.value - b.mean, 6) AS gap FROM q_long f JOIN q_baselines b ON f.metric = b.metric",
)
def j07(spark, sf_dir):
    from .features import staged_features

    features = staged_features(spark, sf_dir)
    stats = ft.population_statistics(features).select("metric", "mean")
    rows = ft.unpivot(features)
    # eight rows, one per metric, by construction
    return rows.join(F.broadcast(stats), "metric").select("site_id", "metric", F.round(F.col("value") - F.col("mean"), 6).alias("gap"))
