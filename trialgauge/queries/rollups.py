"""P: rollups and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as bm
from ..operators import rollups as ru
from ..plans import clinical_views as cv
from ..plans.site_metrics import view_site_metrics
from .benchmarks import _bench
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add(
    "p01_site_summary",
    "SELECT m.site AS site_id, subject_count AS total_subjects, CAST(open_issues AS BIGINT) AS open_issues, round(dqi_score, 4) AS dqi_score, grade, "
    "round(p, 5) AS overall_percentile, rank_desc AS study_rank, n AS study_total FROM q_site_metrics m LEFT JOIN q_bench_overall o ON m.site = o.site "
    "LEFT JOIN q_bench b ON m.site = b.site AND b.metric = 'dqi_score'",
)
def p01(spark, sf_dir):
    m = view_site_metrics(spark, sf_dir)
    rows = ru.site_summary(m, bm.overall(_bench(spark, sf_dir, metrics=m)))
    return rows.drop("overall_level").withColumns({"dqi_score": F.round("dqi_score", 4), "overall_percentile": F.round("overall_percentile", 5)})


@book.add(
    "p02_study_overview",
    "SELECT study, count(*) AS total_sites, CAST(sum(open_issues) AS BIGINT) AS total_issues, string_agg(CASE WHEN r <= 10 THEN site END, ',' ORDER BY r) AS top_sites FROM "
    "(SELECT *, row_number() OVER (PARTITION BY study ORDER BY dqi_score DESC, site) AS r FROM q_site_metrics) q GROUP BY study",
)
def p02(spark, sf_dir):
    s = ru.study_overview(view_site_metrics(spark, sf_dir))
    return s.withColumn("top_sites", F.concat_ws(",", "top_sites"))


@book.add(
    "p03_portfolio_digest",
    "SELECT count(*) AS total_sites, CAST(sum(open_issues) AS BIGINT) AS total_open_issues, (SELECT count(DISTINCT patient_id) FROM v_esae) AS total_subjects FROM q_site_metrics",
)
def p03(spark, sf_dir):
    subjects = cv.safety(spark, sf_dir, ["patient_id"]).toDF("subject")
    return ru.portfolio_digest(view_site_metrics(spark, sf_dir, "rules"), subjects)


@book.add(
    "p04_issue_band",
    "SELECT site, CASE WHEN open_queries = 0 THEN 'No open issues. Site is in good standing.' WHEN open_queries < 10 THEN 'Minor attention required.' "
    "WHEN open_queries < 50 THEN 'Moderate intervention recommended.' ELSE 'Immediate attention required.' END AS band FROM v_site_master",
)
def p04(spark, sf_dir):
    return cv.site_master(spark, sf_dir).select("site", ru.issue_band(F.col("open_queries")).alias("band"))


@book.add(
    "p05_report_recommendations",
    "SELECT site, CASE WHEN t = '' THEN 'Maintain current monitoring practices' ELSE t END AS recommendations FROM (SELECT site, concat_ws('; ', "
    "CASE WHEN open_issues > 50 THEN 'Prioritize issue resolution - schedule dedicated data cleaning sessions' WHEN open_issues > 20 THEN 'Review and categorize open issues for efficient resolution' END, "
    "CASE WHEN dqi_score < 60 THEN 'Conduct detailed data quality review to identify root causes' END) AS t FROM q_site_metrics) q",
)
def p05(spark, sf_dir):
    m = view_site_metrics(spark, sf_dir)
    advice = ru.report_recommendations(F.col("open_issues"), F.col("dqi_score"))
    return m.select("site", F.concat_ws("; ", advice).alias("recommendations"))


@book.add(
    "p06_region_rollup",
    "SELECT region, count(*) AS sites_count, CAST(sum(subject_count) AS BIGINT) AS total_patients, round(avg(dqi_score), 5) AS avg_dqi FROM q_site_metrics GROUP BY region",
)
def p06(spark, sf_dir):
    return ru.region_rollup(view_site_metrics(spark, sf_dir)).withColumn("avg_dqi", F.round("avg_dqi", 5))


@book.add(
    "p07_trial_metrics",
    "SELECT *, CASE WHEN avg_dqi >= 85 THEN 5 WHEN avg_dqi >= 70 THEN 15 WHEN avg_dqi >= 55 THEN 30 ELSE 50 END AS timeline_risk_percent FROM "
    "(SELECT count(*) AS total_sites, CAST(sum(subject_count) AS BIGINT) AS total_patients, round(avg(dqi_score), 5) AS avg_dqi, "
    "(SELECT count(*) FROM v_esae WHERE review_status LIKE 'Pending%') AS total_open_queries FROM q_site_metrics) q",
)
def p07(spark, sf_dir):
    pending = cv.safety(spark, sf_dir, ["review_status"]).where(F.col("review_status").startswith("Pending"))
    return ru.trial_metrics(view_site_metrics(spark, sf_dir), pending).withColumn("avg_dqi", F.round("avg_dqi", 5))


@book.add(
    "p08_site_fact_sheet",
    "SELECT coalesce(p.sitenumber, v.site) AS site, page_rows, missing_days, round(mean_missing_days, 6) AS mean_missing_days, visit_rows, v.days_outstanding FROM "
    "(SELECT sitenumber, count(*) AS page_rows, sum(days_missing) AS missing_days, avg(days_missing) AS mean_missing_days FROM v_pages GROUP BY sitenumber) p "
    "FULL JOIN (SELECT site, count(*) AS visit_rows, sum(days_outstanding) AS days_outstanding FROM v_visit GROUP BY site) v ON p.sitenumber = v.site",
)
def p08(spark, sf_dir):
    pages = cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]).toDF("site", "days")
    visits = cv.visits(spark, sf_dir, ["site", "days_outstanding"]).toDF("site", "days")
    return ru.site_fact_sheet(pages, visits).withColumn("mean_missing_days", F.round("mean_missing_days", 6))
