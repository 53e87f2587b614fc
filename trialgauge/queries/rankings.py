"""R: rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankings as rk
from ..plans import clinical_views as cv
from ..plans import features as ft
from ..plans.site_metrics import view_site_metrics
from ..plans.staging import stage
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

define(
    "q_site_metrics",
    "SELECT m.site, m.study, m.country, m.region, m.subject_count, m.open_queries, s.grade, coalesce(s.score, 50.0) AS dqi_score, "
    "coalesce(i.n, 0.0) AS open_issues, coalesce(f.missing_visits_pct, 0.05) AS missing_visits_pct, 0.8::DOUBLE AS query_resolution_rate, "
    "0.85::DOUBLE AS sdv_completion_pct, coalesce(1.0 - f.safety_pending_pct, 0.9) AS safety_review_rate, m.subject_count / 50.0::DOUBLE AS enrollment_rate "
    "FROM v_site_master m LEFT JOIN q_site_hybrid s ON m.site = s.entity_id LEFT JOIN q_feat f ON m.site = f.site_id "
    "LEFT JOIN (SELECT l.site, CAST(sum(total_open_issue_count_per_subject) AS DOUBLE) AS n FROM v_edrr e JOIN q_lookup l ON e.subject = l.subject GROUP BY l.site) i "
    "ON m.site = i.site",
)
define(
    "q_ranked",
    "SELECT *, (total - rank + 1) * 100.0::DOUBLE / total AS percentile FROM (SELECT site, dqi_score AS value, row_number() OVER (ORDER BY dqi_score DESC, site) AS rank, "
    "count(*) OVER () AS total FROM q_site_metrics) q",
)
define(
    "q_metric_long",
    " UNION ALL ".join(
        f"SELECT site, '{m}' AS metric, {m} AS value, {'-' if down else ''}{m} AS sort_value FROM q_site_metrics"
        for m, down in rk.METRIC_DESCENDING.items()
    ),
)

_COLS = "site, round(value, 4) AS value, rank, total, round(percentile, 4) AS percentile"


def _shown(df, *extra):
    return df.select(*extra, "site", F.round("value", 4).alias("value"), "rank", "total", F.round("percentile", 4).alias("percentile"))


def _ranked(spark, sf_dir, **options):
    return rk.rank_entities(view_site_metrics(spark, sf_dir), "site", "dqi_score", **options)


def _subject_issues(spark, sf_dir):
    return stage(ft.view_issues(spark, sf_dir), "issues")


@book.add("r01_rank_sites", f"SELECT {_COLS} FROM q_ranked")
def r01(spark, sf_dir):
    return _shown(_ranked(spark, sf_dir))


@book.add("r01_rank_sites_large_input_path", f"SELECT {_COLS} FROM q_ranked")
def r01_large(spark, sf_dir):
    """The name of an earlier second path; inputs of every size now take this one."""
    return _shown(_ranked(spark, sf_dir))


@book.add(
    "r01_rank_sites_ascending",
    "SELECT site, round(open_issues, 4) AS value, row_number() OVER (ORDER BY open_issues, site) AS rank FROM q_site_metrics ORDER BY rank LIMIT 20",
)
def r01_asc(spark, sf_dir):
    m = view_site_metrics(spark, sf_dir)
    ranked = rk.rank_entities(m, "site", "open_issues", descending=rk.METRIC_DESCENDING["open_issues"], limit=20)
    return ranked.select("site", F.round("value", 4).alias("value"), "rank")


@book.add(
    "r02_rank_within_study",
    "SELECT study, site, round(dqi_score, 4) AS value, row_number() OVER (PARTITION BY study ORDER BY dqi_score DESC, site) AS rank, "
    "count(*) OVER (PARTITION BY study) AS total FROM q_site_metrics",
)
def r02(spark, sf_dir):
    return _shown(_ranked(spark, sf_dir, within=["study"]), "study").drop("percentile")


@book.add(
    "r02_rank_within_study_large_input_path",
    "SELECT study, site, round(dqi_score, 4) AS value, row_number() OVER (PARTITION BY study ORDER BY dqi_score DESC, site) AS rank, "
    "count(*) OVER (PARTITION BY study) AS total FROM q_site_metrics",
)
def r02_large(spark, sf_dir):
    return _shown(_ranked(spark, sf_dir, within=["study"]), "study").drop("percentile")


_PATIENTS = (
    "SELECT subject, CAST(total_open_issue_count_per_subject AS DOUBLE) AS value, "
    "row_number() OVER (ORDER BY total_open_issue_count_per_subject, subject) AS rank, count(*) OVER () AS total FROM v_edrr"
)


@book.add("r03_rank_patients", f"SELECT * FROM ({_PATIENTS}) q WHERE rank <= 50")
def r03(spark, sf_dir):
    ranked = rk.rank_entities(_subject_issues(spark, sf_dir), "subject", "issue_count", descending=False, limit=50)
    return ranked.select("subject", "value", "rank", "total")


@book.add(
    "r03_rank_patients_by_site",
    "SELECT site, subject, CAST(n AS DOUBLE) AS value, row_number() OVER (PARTITION BY site ORDER BY n, subject) AS rank FROM "
    "(SELECT DISTINCT v.site, e.subject, e.total_open_issue_count_per_subject AS n FROM v_esae v JOIN v_edrr e ON v.patient_id = e.subject) q",
)
def r03_by_site(spark, sf_dir):
    pairs = cv.safety(spark, sf_dir, ["site", "patient_id"]).toDF("site", "subject").distinct()
    rows = stage(pairs.join(ft.view_issues(spark, sf_dir), "subject"), "site-subjects")
    ranked = rk.rank_entities(rows, "subject", "issue_count", descending=False, within=["site"])
    return ranked.select("site", "subject", "value", "rank")


@book.add(
    "r04_site_performers",
    "SELECT site, rank, rank <= greatest(1, total // 4) AS is_top, rank > total - greatest(1, total // 4) AS is_bottom FROM q_ranked",
)
def r04(spark, sf_dir):
    return rk.performer_flags(_ranked(spark, sf_dir)).select("site", "rank", "is_top", "is_bottom")


@book.add(
    "r04_patient_performers",
    f"SELECT subject, rank, rank <= 5 AS is_top, rank > total - 5 AS is_bottom FROM ({_PATIENTS}) q WHERE rank <= 5 OR rank > total - 5",
)
def r04_patients(spark, sf_dir):
    ranked = rk.rank_entities(_subject_issues(spark, sf_dir), "subject", "issue_count", descending=False)
    flagged = rk.performer_flags(ranked, rk.patient_performer_count())
    return flagged.where("is_top OR is_bottom").select("subject", "rank", "is_top", "is_bottom")


@book.add(
    "r05_quartile_flags",
    "SELECT site, percentile >= 75 AS is_top_quartile, percentile <= 25 AS is_bottom_quartile FROM q_ranked",
)
def r05(spark, sf_dir):
    return rk.quartile_flags(_ranked(spark, sf_dir)).select("site", "is_top_quartile", "is_bottom_quartile")


@book.add(
    "r06_metric_fallback",
    "SELECT site, CAST(CASE WHEN subject_count % 3 = 0 THEN open_queries WHEN subject_count % 3 = 1 THEN subject_count ELSE open_queries + 1 END AS DOUBLE) AS open_issues FROM v_site_master",
)
def r06(spark, sf_dir):
    s = cv.site_master(spark, sf_dir)
    mode = F.col("subject_count") % 3
    df = s.select(
        "site",
        F.when(mode == 0, F.col("open_queries").cast("string")).otherwise("n/a").alias("open_issues"),
        F.when(mode == 1, F.col("subject_count").cast("string")).alias("total_issues"),
        (F.col("open_queries") + 1).alias("open_issue_count"),
    )
    return df.select("site", rk.metric_value(df, "open_issues").alias("open_issues"))


@book.add(
    "r07_leaderboard",
    "SELECT * FROM (SELECT metric, site, round(value, 4) AS value, row_number() OVER (PARTITION BY metric ORDER BY sort_value, site) AS rank FROM q_metric_long) q WHERE rank <= 10",
)
def r07(spark, sf_dir):
    return rk.leaderboard(view_site_metrics(spark, sf_dir), "site", 10).withColumn("value", F.round("value", 4))


@book.add(
    "r08_overall_leaderboard",
    "SELECT site, round(a, 6) AS avg_rank, round(p, 6) AS avg_percentile, CASE WHEN a <= 5 THEN 'top_performer' WHEN a <= 15 THEN 'above_average' ELSE 'average' END AS performance_level, "
    "dqi AS dqi_rank FROM (SELECT site, avg(rank) AS a, avg((total - rank + 1) * 100.0::DOUBLE / total) AS p, max(CASE WHEN metric = 'dqi_score' THEN rank END) AS dqi FROM "
    "(SELECT site, metric, row_number() OVER (PARTITION BY metric ORDER BY sort_value, site) AS rank, count(*) OVER (PARTITION BY metric) AS total FROM q_metric_long) q GROUP BY site) z",
)
def r08(spark, sf_dir):
    board = rk.overall_leaderboard(view_site_metrics(spark, sf_dir), "site")
    return board.select(
        "site", F.round("avg_rank", 6).alias("avg_rank"), F.round("avg_percentile", 6).alias("avg_percentile"), "performance_level",
        F.col("metric_ranks")["dqi_score"].alias("dqi_rank"),
    )


@book.add(
    "r09_percentile_histogram",
    "SELECT count(*) FILTER (WHERE percentile <= 25) AS p0_25, count(*) FILTER (WHERE percentile > 25 AND percentile <= 50) AS p25_50, "
    "count(*) FILTER (WHERE percentile > 50 AND percentile <= 75) AS p50_75, count(*) FILTER (WHERE percentile > 75) AS p75_100 FROM q_ranked",
)
def r09(spark, sf_dir):
    return rk.percentile_histogram(_ranked(spark, sf_dir))


@book.add(
    "r10_portfolio_summary",
    "SELECT count(*) AS total_sites, round(avg(value), 1) AS average_dqi, count(*) FILTER (WHERE percentile >= 75) AS top_quartile_count, "
    "count(*) FILTER (WHERE percentile <= 25) AS bottom_quartile_count, CASE WHEN avg(value) >= 70 THEN 'Good' WHEN avg(value) >= 50 THEN 'Needs Attention' ELSE 'Critical' END AS health_label, "
    "string_agg(CASE WHEN rank <= 5 THEN site END, ',' ORDER BY rank) AS top_sites, string_agg(CASE WHEN rank > total - 5 THEN site END, ',' ORDER BY rank DESC) AS bottom_sites FROM q_ranked",
)
def r10(spark, sf_dir):
    return rk.portfolio_summary(_ranked(spark, sf_dir))


@book.add("r11_underperformers", "SELECT site, round(dqi_score, 4) AS dqi_score FROM q_site_metrics ORDER BY q_site_metrics.dqi_score, site LIMIT 10")
def r11(spark, sf_dir):
    return rk.underperformers(view_site_metrics(spark, sf_dir), "site").withColumn("dqi_score", F.round("dqi_score", 4))


@book.add("r11_underperformers_by_issues", "SELECT site, open_issues FROM q_site_metrics ORDER BY open_issues DESC, site LIMIT 10")
def r11_issues(spark, sf_dir):
    return rk.underperformers(view_site_metrics(spark, sf_dir, "rules"), "site", "open_issues")
