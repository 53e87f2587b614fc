"""N: the 25 reference questions over the clinical views, and E6's study metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import coded, status_contains
from ..plans import clinical_views as cv
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

define(
    "q_study_metrics",
    "SELECT study, coalesce(total_issues, 0) AS total_issues, coalesce(avg_issues, 0) AS avg_issues, "
    "coalesce(max_issues, 0) AS max_issues, CAST(coalesce(m, 0) AS DOUBLE) AS meddra_records, CAST(coalesce(e, 0) AS DOUBLE) AS esae_records FROM "
    "(SELECT study, CAST(sum(total_open_issue_count_per_subject) AS BIGINT) AS total_issues, avg(total_open_issue_count_per_subject) AS avg_issues, "
    "max(total_open_issue_count_per_subject) AS max_issues FROM v_edrr GROUP BY study) a "
    "FULL JOIN (SELECT study, count(*) AS m FROM v_meddra GROUP BY study) b USING (study) "
    "FULL JOIN (SELECT study_id AS study, count(*) AS e FROM v_esae GROUP BY study_id) c USING (study)",
)


def study_metrics(spark, sf_dir):
    from ..operators.exploration import study_metrics as combine

    return combine(
        cv.issues(spark, sf_dir),
        cv.meddra(spark, sf_dir, ["study"]),
        cv.safety(spark, sf_dir, ["study_id"]).toDF("study"),
    )


def _count(df, name="n"):
    return df.agg(F.count(F.lit(1)).alias(name))


def _top(df, key, k=1):
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)


@book.add("n01_study_count", "SELECT count(*) AS n FROM q_study_metrics")
def n01(spark, sf_dir):
    return _count(study_metrics(spark, sf_dir))


@book.add("n02_study_with_most_issues", "SELECT study FROM q_study_metrics ORDER BY total_issues DESC, study LIMIT 1")
def n02(spark, sf_dir):
    best = F.min_by("study", F.struct(-F.col("total_issues"), F.col("study")))
    return study_metrics(spark, sf_dir).agg(best.alias("study"))


@book.add("n03_total_issues", "SELECT CAST(sum(total_issues) AS BIGINT) AS n FROM q_study_metrics")
def n03(spark, sf_dir):
    return study_metrics(spark, sf_dir).agg(F.sum("total_issues").alias("n"))


@book.add("n04_meddra_records_of_study", "SELECT count(*) AS n FROM v_meddra WHERE study = 'Study 1'")
def n04(spark, sf_dir):
    return _count(cv.meddra(spark, sf_dir, ["study"]).where(F.col("study") == "Study 1"))


@book.add("n05_whodd_records_of_study", "SELECT count(*) AS n FROM v_whodd WHERE study = 'Study 1'")
def n05(spark, sf_dir):
    return _count(cv.whodd(spark, sf_dir, ["study"]).where(F.col("study") == "Study 1"))


@book.add("n06_discrepancy_count", "SELECT count(*) AS n FROM v_esae")
def n06(spark, sf_dir):
    return _count(cv.safety(spark, sf_dir, ["site"]))


@book.add("n07b_studies_below_issue_mean", "SELECT count(*) AS n FROM q_study_metrics WHERE total_issues < (SELECT avg(total_issues) FROM q_study_metrics)")
def n07b(spark, sf_dir):
    m = study_metrics(spark, sf_dir)
    mean = m.agg(F.avg("total_issues").alias("mean")).withColumn("_k", F.lit(1))
    joined = m.withColumn("_k", F.lit(1)).join(F.broadcast(mean), "_k")
    return joined.agg(F.count_if(F.col("total_issues") < F.col("mean")).alias("n"))


@book.add("n07_studies_without_issues", "SELECT count(*) FILTER (WHERE total_issues = 0) AS n FROM q_study_metrics")
def n07(spark, sf_dir):
    return study_metrics(spark, sf_dir).agg(F.count_if(F.col("total_issues") == 0).alias("n"))


@book.add("n08_missing_page_count", "SELECT count(*) AS n FROM v_pages")
def n08(spark, sf_dir):
    return _count(cv.missing_pages(spark, sf_dir, ["sitenumber"]))


@book.add("n09_distinct_patients", "SELECT count(DISTINCT patient_id) AS n FROM v_esae")
def n09(spark, sf_dir):
    return cv.safety(spark, sf_dir, ["patient_id"]).agg(F.countDistinct("patient_id").alias("n"))


@book.add("n10_subjects_with_issues", "SELECT count(*) AS n FROM v_edrr")
def n10(spark, sf_dir):
    return _count(cv.issues(spark, sf_dir))


@book.add("n11_study_with_most_meddra", "SELECT study, count(*) AS n FROM v_meddra GROUP BY study ORDER BY n DESC, study LIMIT 1")
def n11(spark, sf_dir):
    return _top(cv.meddra(spark, sf_dir, ["study"]), "study")


@book.add("n12_uncoded_terms", "SELECT count(*) FILTER (WHERE coding_status = 'UnCoded Term') AS n FROM v_meddra")
def n12(spark, sf_dir):
    return cv.meddra(spark, sf_dir, ["coding_status"]).agg(F.count_if(F.col("coding_status") == "UnCoded Term").alias("n"))


@book.add("n13_study_with_most_discrepancies", "SELECT study_id, count(*) AS n FROM v_esae GROUP BY study_id ORDER BY n DESC, study_id LIMIT 1")
def n13(spark, sf_dir):
    return _top(cv.safety(spark, sf_dir, ["study_id"]), "study_id")


@book.add("n14_pending_reviews", "SELECT count(*) FILTER (WHERE review_status = 'Pending for Review') AS n FROM v_esae")
def n14(spark, sf_dir):
    df = cv.safety(spark, sf_dir, ["review_status"])
    return df.agg(F.count_if(status_contains(F.col("review_status"), "pending")).alias("n"))


@book.add("n15_distinct_countries", "SELECT count(DISTINCT country) AS n FROM v_esae")
def n15(spark, sf_dir):
    return cv.safety(spark, sf_dir, ["country"]).agg(F.countDistinct("country").alias("n"))


@book.add("n16_study_with_most_missing_pages", "SELECT study_name, count(*) AS n FROM v_pages GROUP BY study_name ORDER BY n DESC, study_name LIMIT 1")
def n16(spark, sf_dir):
    return _top(cv.missing_pages(spark, sf_dir, ["study_name"]), "study_name")


@book.add("n17_max_issues_per_subject", "SELECT max(total_open_issue_count_per_subject) AS n FROM v_edrr")
def n17(spark, sf_dir):
    return cv.issues(spark, sf_dir).agg(F.max("total_open_issue_count_per_subject").alias("n"))


@book.add("n18_distinct_subjects_missing_pages", "SELECT count(DISTINCT subjectname) AS n FROM v_pages")
def n18(spark, sf_dir):
    return cv.missing_pages(spark, sf_dir, ["subjectname"]).agg(F.countDistinct("subjectname").alias("n"))


@book.add(
    "n19_country_with_most_discrepancies",
    "SELECT country, count(*) AS n FROM v_esae WHERE country <> 'None' GROUP BY country ORDER BY n DESC, country LIMIT 1",
)
def n19(spark, sf_dir):
    return _top(cv.safety(spark, sf_dir, ["country"]).where(F.col("country") != "None"), "country")


@book.add("n20_distinct_sites", "SELECT count(DISTINCT site) AS n FROM v_esae")
def n20(spark, sf_dir):
    return cv.safety(spark, sf_dir, ["site"]).agg(F.countDistinct("site").alias("n"))


@book.add(
    "n21_coded_percentage",
    "SELECT round(100.0 * count(*) FILTER (WHERE coding_status = 'Coded Term') / count(*), 6) AS pct FROM v_meddra",
)
def n21(spark, sf_dir):
    share = F.avg(F.when(coded(F.col("coding_status")), 100.0).otherwise(0.0))
    return cv.meddra(spark, sf_dir, ["coding_status"]).agg(F.round(share, 6).alias("pct"))


@book.add("n22_study_with_highest_mean_issues", "SELECT study FROM q_study_metrics ORDER BY avg_issues DESC, study LIMIT 1")
def n22(spark, sf_dir):
    means = cv.issues(spark, sf_dir).groupBy("study").agg(F.avg("total_open_issue_count_per_subject").alias("m"))
    return means.orderBy(F.desc("m"), "study").limit(1).select("study")


@book.add(
    "n23_completed_without_action",
    "SELECT count(*) AS n FROM v_esae WHERE review_status = 'Review Completed' AND action_status = 'No action required'",
)
def n23(spark, sf_dir):
    df = cv.safety(spark, sf_dir, ["review_status", "action_status"])
    return _count(df.where((F.col("review_status") == "Review Completed") & (F.col("action_status") == "No action required")))


@book.add("n24_top3_studies_by_whodd", "SELECT study, count(*) AS n FROM v_whodd GROUP BY study ORDER BY n DESC, study LIMIT 3")
def n24(spark, sf_dir):
    return _top(cv.whodd(spark, sf_dir, ["study"]), "study", 3)


@book.add(
    "n25_coding_records_of_study",
    "SELECT (SELECT count(*) FROM v_meddra WHERE study = 'Study 4') + (SELECT count(*) FROM v_whodd WHERE study = 'Study 4') AS n",
)
def n25(spark, sf_dir):
    both = cv.meddra(spark, sf_dir, ["study"]).unionAll(cv.whodd(spark, sf_dir, ["study"]))
    return _count(both.where(F.col("study") == "Study 4"))
