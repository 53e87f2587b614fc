"""E: exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exploration as ex
from ..plans import clinical_views as cv
from .book import Book
from .golden import study_metrics

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add(
    "e01_value_counts",
    "SELECT 'study' AS field, study AS value, count(*) AS n FROM v_visit GROUP BY study "
    "UNION ALL SELECT 'coding', coding_status, count(*) FROM v_meddra GROUP BY 2 "
    "UNION ALL SELECT 'require', require_coding, count(*) FROM v_meddra GROUP BY 2 "
    "UNION ALL SELECT 'review', review_status, count(*) FROM v_esae GROUP BY 2",
)
def e01(spark, sf_dir):
    coding = cv.meddra(spark, sf_dir, ["coding_status", "require_coding"])
    parts = [
        ("study", cv.visits(spark, sf_dir, ["study"]), "study"),
        ("coding", coding, "coding_status"),
        ("require", coding, "require_coding"),
        ("review", cv.safety(spark, sf_dir, ["review_status"]), "review_status"),
    ]
    out = None
    for label, df, column in parts:
        rows = ex.value_counts(df, column).select(F.lit(label).alias("field"), F.col(column).alias("value"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@book.add("e02_top_countries", "SELECT country, count(*) AS n FROM v_esae GROUP BY country ORDER BY n DESC, country LIMIT 10")
def e02(spark, sf_dir):
    return ex.top_values(cv.safety(spark, sf_dir, ["country"]), "country", 10)


@book.add(
    "e03_histogram",
    "SELECT bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, count(*) AS n FROM (SELECT lo, hi, "
    "CAST(least(29, floor((days_missing - lo) / ((hi - lo) / 30))) AS BIGINT) AS bin FROM v_pages, "
    "(SELECT min(days_missing) AS lo, max(days_missing) AS hi FROM v_pages) b) q GROUP BY bin, lo, hi",
)
def e03(spark, sf_dir):
    h = ex.histogram(cv.missing_pages(spark, sf_dir, ["days_missing"]), "days_missing", 30)
    return h.withColumn("lower", F.round("lower", 6))


@book.add("e04_mean_days_by_status", "SELECT foldername, round(avg(days_missing), 6) AS mean FROM v_pages GROUP BY foldername")
def e04(spark, sf_dir):
    df = cv.missing_pages(spark, sf_dir, ["foldername", "days_missing"])
    return ex.mean_by(df, "foldername", "days_missing").withColumn("mean", F.round("mean", 6))


@book.add(
    "e05_issues_by_study",
    "SELECT study, CAST(sum(total_open_issue_count_per_subject) AS BIGINT) AS total FROM v_edrr GROUP BY study",
)
def e05(spark, sf_dir):
    return ex.sum_by(cv.issues(spark, sf_dir), "study", "total_open_issue_count_per_subject")


@book.add(
    "e06_study_metrics",
    "SELECT study, total_issues, round(avg_issues, 6) AS avg_issues, max_issues, meddra_records, esae_records FROM q_study_metrics",
)
def e06(spark, sf_dir):
    return study_metrics(spark, sf_dir).withColumn("avg_issues", F.round("avg_issues", 6))
