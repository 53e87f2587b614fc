"""F: site, subject and study features; population statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import FEATURE_DEFAULTS
from ..plans import clinical_views as cv
from ..plans import features as ft
from ..plans.staging import kept, stage
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

M = ft.METRICS

define("q_universe", "SELECT site FROM v_visit UNION SELECT sitenumber FROM v_pages UNION SELECT site FROM v_esae")
define(
    "q_lookup",
    "SELECT patient_id AS subject, site FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created, discrepancy_id, site) AS rn "
    "FROM v_esae) q WHERE rn = 1",
)
define(
    "q_rates",
    "SELECT (SELECT avg(CASE WHEN coding_status = 'Coded Term' THEN 1.0 ELSE 0.0 END) FROM v_meddra) AS m, "
    "(SELECT avg(CASE WHEN coding_status = 'Coded Term' THEN 1.0 ELSE 0.0 END) FROM v_whodd) AS w",
)
define(
    "q_feat",
    "SELECT u.site AS site_id, least(1.0, coalesce(v.n, 0) / 100.0::DOUBLE) AS missing_visits_pct, "
    "least(1.0, coalesce(p.n, 0) / 50.0::DOUBLE) AS missing_pages_pct, coalesce(i.a, 0.0) AS open_issues_per_subject, "
    "coalesce(s.a, 0.0) AS safety_pending_pct, m AS meddra_coding_rate, w AS whodd_coding_rate, "
    "coalesce(v.d, 0.0) AS days_outstanding_avg, coalesce(p.d, 0.0) AS days_pages_missing_avg FROM q_universe u "
    "LEFT JOIN (SELECT site, count(*) AS n, avg(days_outstanding) AS d FROM v_visit GROUP BY site) v ON u.site = v.site "
    "LEFT JOIN (SELECT sitenumber, count(*) AS n, avg(days_missing) AS d FROM v_pages GROUP BY sitenumber) p ON u.site = p.sitenumber "
    "LEFT JOIN (SELECT site, avg(CASE WHEN contains(lower(review_status), 'pending') THEN 1.0 ELSE 0.0 END) AS a FROM v_esae GROUP BY site) s "
    "ON u.site = s.site "
    "LEFT JOIN (SELECT l.site, avg(total_open_issue_count_per_subject) AS a FROM v_edrr e JOIN q_lookup l ON e.subject = l.subject GROUP BY l.site) i "
    "ON u.site = i.site, q_rates",
)


def long_sql(table: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS entity_id, '{m}' AS metric, {m} AS value FROM {table}" for m in M)


define("q_long", long_sql("q_feat", "site_id"))
define(
    "q_baselines",
    "SELECT metric, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END AS std, min(value) AS min, max(value) AS max, "
    "quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, "
    "quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95 FROM q_long GROUP BY metric",
)
define(
    "q_patient_feat",
    "SELECT coalesce(i.subject, s.patient_id) AS patient_id, 0.0 AS missing_visits_pct, 0.0 AS missing_pages_pct, "
    "coalesce(CAST(i.n AS DOUBLE), 0.0) AS open_issues_per_subject, coalesce(s.a, 0.0) AS safety_pending_pct, 0.99 AS meddra_coding_rate, "
    "0.99 AS whodd_coding_rate, 0.0 AS days_outstanding_avg, 0.0 AS days_pages_missing_avg FROM "
    "(SELECT subject, total_open_issue_count_per_subject AS n FROM v_edrr) i FULL JOIN "
    "(SELECT patient_id, avg(CASE WHEN contains(lower(review_status), 'pending') THEN 1.0 ELSE 0.0 END) AS a FROM v_esae GROUP BY patient_id) s "
    "ON i.subject = s.patient_id",
)
define(
    "q_study_feat",
    "SELECT g.study_id, " + ", ".join(f"coalesce(a.{m}, {ft.STUDY_DEFAULTS[m]}) AS {m}" for m in M) + " FROM "
    "(SELECT DISTINCT 'Study ' || n_regionkey AS study_id FROM nation) g LEFT JOIN (SELECT study_id, "
    + ", ".join(f"greatest(min({m}), least(max({m}), avg({m}))) AS {m}" for m in M)
    + " FROM (SELECT DISTINCT study_id, site FROM v_esae) p JOIN q_feat f ON p.site = f.site_id GROUP BY study_id) a ON g.study_id = a.study_id",
)


def rounded(df, columns=M, places=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def rounded_sql(columns=M, places=6) -> str:
    return ", ".join(f"CAST(round({c}, {places}) AS DOUBLE) AS {c}" for c in columns)


def staged_features(spark, sf_dir):
    """Site features, materialised once per input."""
    return kept(
        spark, "features", cv.source_paths(sf_dir), lambda: stage(ft.view_site_features(spark, sf_dir), "features")
    )


def study_sites(spark, sf_dir):
    return cv.safety(spark, sf_dir, ["study_id", "site"])


def view_studies(spark, sf_dir):
    nation = cv.table(spark, sf_dir, "nation")
    return nation.select(F.concat(F.lit("Study "), F.col("n_regionkey").cast("string")).alias("study_id")).distinct()


def view_study_features(spark, sf_dir):
    return ft.study_features(ft.view_site_features(spark, sf_dir), study_sites(spark, sf_dir), view_studies(spark, sf_dir))


def view_patient_features(spark, sf_dir):
    safety = cv.safety(spark, sf_dir, ["patient_id", "review_status"]).toDF("subject", "status")
    issues = ft.view_issues(spark, sf_dir).withColumn("row_ord", F.col("subject"))
    return ft.patient_features(issues, safety)


@book.add("f01_site_universe", "SELECT site AS site_id FROM q_universe")
def f01(spark, sf_dir):
    src = ft.Sources(
        visits=cv.visits(spark, sf_dir, ["site", "days_outstanding"]).toDF("site", "days"),
        pages=cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]).toDF("site", "days"),
        safety=cv.safety(spark, sf_dir, ["site", "review_status"]).toDF("site", "status"),
    )
    return ft.site_totals(src).select("site_id")


def _one_feature(name: str, metric: str):
    @book.add(name, f"SELECT site_id, round({metric}, 6) AS {metric} FROM q_feat")
    def query(spark, sf_dir):
        return rounded(ft.view_site_features(spark, sf_dir, coding="default"), [metric]).select("site_id", metric)

    return query


for _name, _metric in (
    ("f02_missing_visits", "missing_visits_pct"),
    ("f03_days_outstanding", "days_outstanding_avg"),
    ("f04_missing_pages", "missing_pages_pct"),
    ("f06_safety_pending", "safety_pending_pct"),
    ("f07_open_issues", "open_issues_per_subject"),
):
    _one_feature(_name, _metric)


@book.add(
    "f05_days_pages_missing",
    "SELECT site, round(avg(coalesce(d, 0)), 6) AS filled, round(coalesce(avg(d), 0.0), 6) AS skipped FROM "
    "(SELECT sitenumber AS site, CASE WHEN days_missing > 100 THEN NULL ELSE days_missing END AS d FROM v_pages) q GROUP BY site",
)
def f05(spark, sf_dir):
    pages = cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]).select(
        F.col("sitenumber").alias("site"), F.when(F.col("days_missing") <= 100, F.col("days_missing")).alias("days")
    )
    both = [ft.site_features(ft.Sources(pages=pages), fill_null_days=flag) for flag in (True, False)]
    filled = both[0].select("site_id", F.round("days_pages_missing_avg", 6).alias("filled"))
    skipped = both[1].select("site_id", F.round("days_pages_missing_avg", 6).alias("skipped"))
    return filled.join(skipped, "site_id").withColumnRenamed("site_id", "site")


@book.add(
    "f07b_issues_per_subject_in_site",
    "SELECT a.site, round(by_issues, 6) AS by_issues, round(by_rows, 6) AS by_rows FROM "
    "(SELECT p.site, avg(total_open_issue_count_per_subject) AS by_issues FROM (SELECT DISTINCT site, patient_id FROM v_esae) p "
    "JOIN v_edrr e ON p.patient_id = e.subject GROUP BY p.site) a JOIN "
    "(SELECT site, count(*)::DOUBLE / greatest(1, count(DISTINCT patient_id)) AS by_rows FROM v_esae GROUP BY site) b ON a.site = b.site",
)
def f07b(spark, sf_dir):
    safety = cv.safety(spark, sf_dir, ["site", "patient_id"]).toDF("site", "subject")
    by_issues = ft.issues_per_subject_in_site(safety, ft.view_issues(spark, sf_dir))
    by_rows = ft.issues_per_subject_in_site(safety)
    name = "open_issues_per_subject"
    return by_issues.select("site", F.round(name, 6).alias("by_issues")).join(
        by_rows.select("site", F.round(name, 6).alias("by_rows")), "site"
    )


def _coding_query(name: str, view: str, fn):
    @book.add(
        name,
        "SELECT round(avg(CASE WHEN coding_status = 'Coded Term' THEN 1.0 ELSE 0.0 END), 6) AS word_rate, "
        f"round(avg(CASE WHEN contains(lower(coding_status), 'coded') THEN 1.0 ELSE 0.0 END), 6) AS substring_rate FROM {view}",
    )
    def query(spark, sf_dir):
        from ..operators.cleaning import coded

        df = fn(spark, sf_dir, ["coding_status"])
        share = lambda m: F.round(F.avg(F.when(coded(F.col("coding_status"), m), 1.0).otherwise(0.0)), 6)
        return df.agg(share("word").alias("word_rate"), share("substring").alias("substring_rate"))

    return query


_coding_query("f08_meddra_coding_rate", "v_meddra", cv.meddra)
_coding_query("f09_whodd_coding_rate", "v_whodd", cv.whodd)


@book.add("f10_site_features", f"SELECT site_id, {rounded_sql()} FROM q_feat")
def f10(spark, sf_dir):
    return rounded(ft.view_site_features(spark, sf_dir))


@book.add("f11_patient_features", f"SELECT patient_id, {rounded_sql()} FROM q_patient_feat")
def f11(spark, sf_dir):
    return rounded(view_patient_features(spark, sf_dir))


@book.add(
    "f11b_patient_by_containment",
    "SELECT subject, total_open_issue_count_per_subject AS issue_count FROM v_edrr WHERE contains(subject, 'Subject 1')",
)
def f11b(spark, sf_dir):
    return ft.patients_matching(ft.view_issues(spark, sf_dir), "subject", "Subject 1", match="contains")


@book.add("f12_study_features", f"SELECT study_id, {rounded_sql()} FROM q_study_feat")
def f12(spark, sf_dir):
    return rounded(view_study_features(spark, sf_dir))


_STATS = ["mean", "std", "min", "max", "p25", "p50", "p75", "p90", "p95"]


@book.add("f13_population_statistics", f"SELECT metric, {rounded_sql(_STATS)} FROM q_baselines")
def f13(spark, sf_dir):
    return rounded(ft.population_statistics(staged_features(spark, sf_dir)), _STATS)


@book.add("f13_large_input_path", f"SELECT metric, {rounded_sql(_STATS)} FROM q_baselines")
def f13_large(spark, sf_dir):
    """The distributed order-statistics path, forced on the same input."""
    return rounded(ft.population_statistics(staged_features(spark, sf_dir)), _STATS)


assert FEATURE_DEFAULTS.keys() == set(M)
