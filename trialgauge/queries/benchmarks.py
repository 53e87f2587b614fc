"""B: peer benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as bm
from ..plans import clinical_views as cv
from ..plans.site_metrics import view_site_metrics
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

define(
    "q_bench_long",
    " UNION ALL ".join(f"SELECT site, study, country, '{m}' AS metric, {m} AS value FROM q_site_metrics" for m in bm.BENCHMARK_METRICS),
)


def _bench_sql(cohort: str) -> str:
    return (
        "SELECT *, CASE WHEN metric IN ('open_issues', 'missing_visits_pct') THEN 100 - p0 ELSE p0 END AS percentile, "
        "CASE WHEN metric IN ('open_issues', 'missing_visits_pct') THEN -z0 ELSE z0 END AS z_score FROM ("
        "SELECT a.site, a.metric, a.value, avg(b.value) AS cohort_mean, median(b.value) AS cohort_median, "
        "CASE WHEN count(*) > 1 THEN stddev_samp(b.value) ELSE 0.01 END AS cohort_std, min(b.value) AS cohort_min, max(b.value) AS cohort_max, "
        "(count(*) FILTER (WHERE b.value < a.value) + 1) * 100.0::DOUBLE / (count(*) + 1) AS p0, "
        "CASE WHEN (CASE WHEN count(*) > 1 THEN stddev_samp(b.value) ELSE 0.01 END) > 0 THEN (a.value - avg(b.value)) / "
        "(CASE WHEN count(*) > 1 THEN stddev_samp(b.value) ELSE 0.01 END) ELSE 0.0 END AS z0, "
        "count(*) FILTER (WHERE b.value > a.value) + 1 AS rank_desc, count(*) + 1 AS n "
        f"FROM q_bench_long a JOIN q_bench_long b ON a.metric = b.metric AND {cohort} AND a.site <> b.site GROUP BY a.site, a.metric, a.value) q"
    )


_LEVEL = (
    "CASE WHEN {p} >= 90 THEN 'top_performer' WHEN {p} >= 70 THEN 'above_average' WHEN {p} >= 30 THEN 'average' WHEN {p} >= 10 THEN 'below_average' ELSE 'underperformer' END"
)
define("q_bench", _bench_sql("a.study = b.study"))
define("q_bench_country", _bench_sql("a.country = b.country"))
define("q_bench_global", _bench_sql("TRUE"))
_LEVEL_P = _LEVEL.format(p="round(percentile, 9)")


def _bench(spark, sf_dir, metrics=None):
    m = metrics if metrics is not None else view_site_metrics(spark, sf_dir)
    own, members = bm.study_cohorts(cv.safety(spark, sf_dir, ["site", "study_id"]).toDF("study", "site"), m)
    return bm.benchmark_sites(m, own, members)


_STATS = ["cohort_mean", "cohort_median", "cohort_std", "cohort_min", "cohort_max"]
_STATS_SQL = ", ".join(f"round({c}, 5) AS {c}" for c in _STATS)


def _stats(df):
    return df.select("site", "metric", *[F.round(c, 5).alias(c) for c in _STATS])


@book.add(
    "b01_site_metric_vector",
    "SELECT site, " + ", ".join(f"round({m}, 5) AS {m}" for m in bm.BENCHMARK_METRICS) + " FROM q_site_metrics",
)
def b01(spark, sf_dir):
    return view_site_metrics(spark, sf_dir).select("site", *[F.round(m, 5).alias(m) for m in bm.BENCHMARK_METRICS])


@book.add("b02_study_cohort", "SELECT a.site, count(*) AS peers FROM v_sites a JOIN v_sites b ON a.study = b.study GROUP BY a.site")
def b02(spark, sf_dir):
    pairs = cv.safety(spark, sf_dir, ["site", "study_id"]).toDF("study", "site")
    own, members = bm.study_cohorts(pairs, cv.sites(spark, sf_dir))
    sizes = members.groupBy("cohort").agg(F.count(F.lit(1)).alias("peers"))
    return own.join(sizes, "cohort").select("site", "peers")


@book.add(
    "b03_regional_and_global_cohorts",
    f"SELECT 'country' AS cohort_kind, site, metric, {_STATS_SQL} FROM q_bench_country WHERE metric = 'dqi_score' UNION ALL "
    f"SELECT 'global', site, metric, {_STATS_SQL} FROM q_bench_global WHERE metric = 'dqi_score'",
)
def b03(spark, sf_dir):
    m = view_site_metrics(spark, sf_dir)
    out = None
    for label, column in (("country", "country"), ("global", None)):
        rows = _stats(bm.benchmark_sites(m, *bm.attribute_cohorts(m, column)))
        rows = rows.where(F.col("metric") == "dqi_score").withColumn("cohort_kind", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


@book.add("b04_cohort_statistics", f"SELECT site, metric, {_STATS_SQL} FROM q_bench")
def b04(spark, sf_dir):
    return _stats(_bench(spark, sf_dir))


@book.add("b04_cohort_statistics_large_input_path", f"SELECT site, metric, {_STATS_SQL} FROM q_bench")
def b04_large(spark, sf_dir):
    return _stats(_bench(spark, sf_dir))


@book.add("b05_percentile_and_z", "SELECT site, metric, round(percentile, 5) AS percentile, round(z_score, 4) AS z_score FROM q_bench")
def b05(spark, sf_dir):
    return _bench(spark, sf_dir).select("site", "metric", F.round("percentile", 5).alias("percentile"), F.round("z_score", 4).alias("z_score"))


@book.add("b06_performance_level", f"SELECT site, metric, {_LEVEL_P} AS performance_level FROM q_bench")
def b06(spark, sf_dir):
    return _bench(spark, sf_dir).select("site", "metric", bm.performance_level(F.round("percentile", 9)).alias("performance_level"))


define("q_bench_overall", "SELECT site, avg(percentile) AS p FROM q_bench GROUP BY site")


@book.add(
    "b07_overall_level",
    f"SELECT site, round(p, 5) AS overall_percentile, {_LEVEL.format(p='round(p, 9)')} AS overall_level FROM q_bench_overall",
)
def b07(spark, sf_dir):
    o = bm.overall(_bench(spark, sf_dir))
    return o.select(
        "site", F.round("overall_percentile", 5).alias("overall_percentile"),
        bm.performance_level(F.round("overall_percentile", 9)).alias("overall_level"),
    )


_TITLES = ", ".join(f"('{m}', '{m.replace('_', ' ').title()}', {i})" for i, m in enumerate(bm.BENCHMARK_METRICS))
define("q_titles", f"SELECT * FROM (VALUES {_TITLES}) t(metric, title, ord)")


@book.add(
    "b08_strengths_weaknesses",
    "SELECT site, coalesce(string_agg(CASE WHEN percentile >= 75 THEN title END, ', ' ORDER BY ord), '') AS strengths, "
    "coalesce(string_agg(CASE WHEN percentile <= 25 THEN title END, ', ' ORDER BY ord), '') AS weaknesses FROM q_bench JOIN q_titles USING (metric) GROUP BY site",
)
def b08(spark, sf_dir):
    o = bm.overall(_bench(spark, sf_dir))
    return o.select("site", F.concat_ws(", ", "strengths").alias("strengths"), F.concat_ws(", ", "weaknesses").alias("weaknesses"))


@book.add("b09_study_rank", "SELECT site, rank_desc AS study_rank, n AS study_total FROM q_bench WHERE metric = 'dqi_score'")
def b09(spark, sf_dir):
    return bm.overall(_bench(spark, sf_dir)).select("site", "study_rank", "study_total")


@book.add(
    "b10_study_benchmark",
    "SELECT study, count(*) AS site_count, CAST(sum(subject_count) AS BIGINT) AS subject_count, round(avg(dqi_score), 5) AS avg_site_dqi, round(min(dqi_score), 5) AS min_site_dqi, "
    "round(max(dqi_score), 5) AS max_site_dqi, round(coalesce(stddev_samp(dqi_score), 0), 5) AS dqi_std, "
    "string_agg(CASE WHEN r <= 5 THEN site END, ',' ORDER BY r) AS top_sites, coalesce(string_agg(CASE WHEN r > c - 5 AND c > 5 THEN site END, ',' ORDER BY r), '') AS bottom_sites FROM "
    "(SELECT *, row_number() OVER (PARTITION BY study ORDER BY dqi_score DESC, site) AS r, count(*) OVER (PARTITION BY study) AS c FROM q_site_metrics) q GROUP BY study",
)
def b10(spark, sf_dir):
    s = bm.study_summary(view_site_metrics(spark, sf_dir))
    nums = ["avg_site_dqi", "min_site_dqi", "max_site_dqi", "dqi_std"]
    return s.select(
        "study", "site_count", "subject_count", *[F.round(c, 5).alias(c) for c in nums],
        F.concat_ws(",", "top_sites").alias("top_sites"), F.concat_ws(",", "bottom_sites").alias("bottom_sites"),
    )


@book.add(
    "b10_study_metric_summary",
    "SELECT study, metric, round(avg(value), 5) AS mean, round(median(value), 5) AS median, round(coalesce(stddev_samp(value), 0), 5) AS std, round(min(value), 5) AS min, "
    "round(max(value), 5) AS max FROM q_bench_long GROUP BY study, metric",
)
def b10_metrics(spark, sf_dir):
    s = bm.study_metric_summary(view_site_metrics(spark, sf_dir))
    return s.select("study", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "median", "std", "min", "max")])


@book.add(
    "b11_recommendations",
    "SELECT site, coalesce(string_agg(a, '; ' ORDER BY ord), 'Maintain current performance levels') AS recommendations FROM ("
    "SELECT site, ord, CASE WHEN percentile <= 25 THEN 'Focus on ' || replace(metric, '_', ' ') || ': Currently at ' || printf('%.0f', round(percentile, 9)) || 'th percentile (value: ' || "
    "printf('%.2f', round(value, 9)) || ' vs cohort avg: ' || printf('%.2f', round(cohort_mean, 9)) || ')' END AS a, "
    "row_number() OVER (PARTITION BY site, percentile <= 25 ORDER BY ord) AS rn FROM q_bench JOIN q_titles USING (metric)) q WHERE rn <= 5 OR a IS NULL GROUP BY site",
)
def b11(spark, sf_dir):
    return bm.overall(_bench(spark, sf_dir)).select("site", F.concat_ws("; ", "recommendations").alias("recommendations"))


@book.add(
    "b12_percentile_label",
    "SELECT site, metric, CASE WHEN percentile >= 90 THEN 'Excellent (Top 10%)' WHEN percentile >= 75 THEN 'Good (Top 25%)' WHEN percentile >= 50 THEN 'Average' "
    "WHEN percentile >= 25 THEN 'Below Average' ELSE 'Needs Improvement' END AS label FROM (SELECT site, metric, round(percentile, 9) AS percentile FROM q_bench) q",
)
def b12(spark, sf_dir):
    return _bench(spark, sf_dir).select("site", "metric", bm.percentile_label(F.round("percentile", 9)).alias("label"))


@book.add(
    "b13_display_value",
    "SELECT site, metric, CASE WHEN metric IN ('missing_visits_pct', 'query_resolution_rate', 'sdv_completion_pct') THEN printf('%.1f', value * 100) || '%' "
    "WHEN metric = 'dqi_score' THEN printf('%.1f', value) WHEN metric = 'open_issues' THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', value) END AS shown FROM q_bench_long",
)
def b13(spark, sf_dir):
    rows = view_site_metrics(spark, sf_dir).unpivot(["site"], bm.BENCHMARK_METRICS, "metric", "value")
    return rows.select("site", "metric", bm.display_value(F.col("metric"), F.col("value")).alias("shown"))
