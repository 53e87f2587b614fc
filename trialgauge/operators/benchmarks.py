"""Peer benchmarks: every site against its cohort, itself excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import exact_quantiles, top_per_group, with_position
from ..plans.staging import stage

BENCHMARK_METRICS = [
    "dqi_score",
    "open_issues",
    "missing_visits_pct",
    "query_resolution_rate",
    "sdv_completion_pct",
    "safety_review_rate",
    "enrollment_rate",
]

# What an absent site property counts as.
METRIC_DEFAULTS = {
    "dqi_score": 50.0,
    "open_issues": 0.0,
    "missing_visits_pct": 0.05,
    "query_resolution_rate": 0.8,
    "sdv_completion_pct": 0.85,
    "safety_review_rate": 0.9,
    "enrollment_rate": 0.0,
}

SUBJECTS_PER_ENROLLMENT_UNIT = 50.0
LOWER_IS_BETTER = ["open_issues", "missing_visits_pct"]
SINGLE_PEER_STD = 0.01
_NOISE = 1e-9


def site_metric_vector(sites: DataFrame, subjects: DataFrame, properties: DataFrame) -> DataFrame:
    """Seven metrics per site from known properties, defaults elsewhere.

    ``sites(site, …)``, ``subjects(site, subject_count)``, ``properties(site, <metric>…)``.
    """
    joined = sites.join(subjects, "site", "left").join(properties, "site", "left")
    known = set(properties.columns)
    cols = []
    for m in BENCHMARK_METRICS:
        if m == "enrollment_rate":
            value = F.coalesce(F.col("subject_count") / SUBJECTS_PER_ENROLLMENT_UNIT, F.lit(0.0))
        elif m in known:
            value = F.coalesce(F.col(m).cast("double"), F.lit(METRIC_DEFAULTS[m]))
        else:
            value = F.lit(METRIC_DEFAULTS[m])
        cols.append(value.alias(m))
    return joined.select(*sites.columns, "subject_count", *cols)


def study_cohorts(site_study: DataFrame, all_sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cohorts of sites that share a study: ``(site, cohort)`` and ``(cohort, peer)``.

    Sites with the same set of studies have the same cohort, so a cohort is listed once
    per distinct set, not once per site. Sites without a study join one global cohort.
    """
    pairs = site_study.where(F.col("study").isNotNull()).select("site", "study").distinct()
    own = pairs.groupBy("site").agg(F.array_sort(F.collect_set("study")).alias("studies"))
    own = all_sites.select("site").distinct().join(own, "site", "left")
    own = own.withColumn("cohort", F.coalesce(F.concat_ws("|", "studies"), F.lit("")))
    sets = own.where(F.col("cohort") != "").select("cohort", "studies").distinct().select("cohort", F.explode("studies").alias("study"))
    members = sets.join(pairs, "study").select("cohort", F.col("site").alias("peer")).distinct()
    loners = own.where(F.col("cohort") == "").select("cohort").distinct()
    everyone = all_sites.select(F.lit("").alias("cohort"), F.col("site").alias("peer")).distinct().join(loners, "cohort", "left_semi")
    return own.select("site", "cohort"), members.unionByName(everyone)


def attribute_cohorts(sites: DataFrame, column: str | None) -> tuple[DataFrame, DataFrame]:
    """Cohort = sites with equal ``column``; ``None`` is the global cohort."""
    key = F.col(column) if column else F.lit("all")
    return sites.select("site", key.alias("cohort")), sites.select(key.alias("cohort"), F.col("site").alias("peer"))


# Levels and labels of a percentile.
def performance_level(p: Column) -> Column:
    return (
        F.when(p >= 90, "top_performer")
        .when(p >= 70, "above_average")
        .when(p >= 30, "average")
        .when(p >= 10, "below_average")
        .otherwise("underperformer")
    )


def percentile_label(p: Column) -> Column:
    return (
        F.when(p >= 90, "Excellent (Top 10%)")
        .when(p >= 75, "Good (Top 25%)")
        .when(p >= 50, "Average")
        .when(p >= 25, "Below Average")
        .otherwise("Needs Improvement")
    )


# Display unit of each metric.
METRIC_UNITS = {
    "dqi_score": "score",
    "open_issues": "count",
    "missing_visits_pct": "%",
    "query_resolution_rate": "%",
    "sdv_completion_pct": "%",
    "enrollment_rate": "rate",
}


def display_value(metric: Column, value: Column) -> Column:
    from ..functions.scoring import fixed

    unit = F.create_map(*[F.lit(x) for kv in METRIC_UNITS.items() for x in kv])[metric]
    return (
        F.when(unit == "%", F.concat(fixed(value * 100, 1), F.lit("%")))
        .when(unit == "score", fixed(value, 1))
        .when(unit == "count", value.cast("long").cast("string"))
        .otherwise(fixed(value, 2))
    )


def benchmark_sites(
    metrics: DataFrame, own_cohort: DataFrame, members: DataFrame
) -> DataFrame:
    """One row per site and metric against the other sites of its cohort.

    Nothing is paired: mean and deviation without self follow from cohort moments, and
    median and extremes without self from at most seven order statistics per cohort and
    the site's own position.
    """
    values = members.join(metrics.withColumnRenamed("site", "peer"), "peer").select("cohort", "peer", *BENCHMARK_METRICS)
    rows = values.unpivot(["cohort", "peer"], BENCHMARK_METRICS, "metric", "value")
    # repeated values are ordered by site, so positions are unique
    placed = stage(
        with_position(stage(rows, "cohort"), [F.asc("value"), F.asc("peer")], ["cohort", "metric"], "pos", "n"),
        "cohort",
    )
    ties = placed.groupBy("cohort", "metric", "value").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    others = F.col("n") - 1
    mid = F.floor((others + 1) / 2)

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("pos") == position, F.col("value")))

    cohort = placed.groupBy("cohort", "metric").agg(
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
        at(F.lit(1)).alias("v1"),
        at(F.lit(2)).alias("v2"),
        at(F.col("n")).alias("vn"),
        at(F.col("n") - 1).alias("vn1"),
        at(mid).alias("c0"),
        at(mid + 1).alias("c1"),
        at(mid + 2).alias("c2"),
    )
    mine = own_cohort.join(placed, (own_cohort.site == placed.peer) & own_cohort.cohort.eqNullSafe(placed.cohort)).select(
        "site", placed.cohort, "metric", "value", "pos", "n"
    )
    x = (
        mine.where(F.col("n") > 1)
        .join(ties, ["cohort", "metric", "value"])
        .join(cohort, ["cohort", "metric"])
    )
    peers = F.col("n") - 1
    half = F.floor((peers + 1) / 2)
    loo_mean = (F.col("n") * F.col("mean") - F.col("value")) / peers
    loo_m2 = F.greatest(F.lit(0.0), F.col("m2") - (F.col("value") - F.col("mean")) * (F.col("value") - loo_mean))
    loo_std = F.when(peers > 1, F.sqrt(loo_m2 / (peers - 1))).otherwise(F.lit(SINGLE_PEER_STD))
    quiet = loo_std <= _NOISE * F.greatest(F.lit(1.0), F.abs(loo_mean))
    low = F.when(F.col("pos") > half, F.col("c0")).otherwise(F.col("c1"))
    high = F.when(F.col("pos") > half + 1, F.col("c1")).otherwise(F.col("c2"))
    x = x.withColumns(
        {
            "cohort_mean": loo_mean,
            "cohort_std": F.when(quiet, 0.0).otherwise(loo_std),
            "cohort_median": F.when(peers % 2 == 1, low).otherwise((low + high) / 2),
            "cohort_min": F.when(F.col("pos") == 1, F.col("v2")).otherwise(F.col("v1")),
            "cohort_max": F.when(F.col("pos") == F.col("n"), F.col("vn1")).otherwise(F.col("vn")),
            "raw_percentile": F.col("first_pos") / F.col("n") * 100.0,
        }
    )
    raw_z = F.when(F.col("cohort_std") > 0, (F.col("value") - F.col("cohort_mean")) / F.col("cohort_std")).otherwise(0.0)
    inverted = F.col("metric").isin(LOWER_IS_BETTER)
    x = x.withColumns(
        {
            "percentile": F.when(inverted, 100.0 - F.col("raw_percentile")).otherwise(F.col("raw_percentile")),
            "z_score": F.when(inverted, -raw_z).otherwise(raw_z),
            "rank_desc": F.col("n") - F.col("last_pos") + 1,
        }
    )
    return x.select(
        "site", "cohort", "metric", "value", "cohort_mean", "cohort_median", "cohort_std", "cohort_min", "cohort_max",
        "percentile", "z_score", performance_level(F.col("percentile")).alias("performance_level"), "rank_desc", "n",
    )


def overall(bench: DataFrame) -> DataFrame:
    """Per site: mean percentile, level, strengths, weaknesses, advice, rank by quality index.

    At most seven metric rows exist per site, so the lists are bounded.
    """
    from ..functions.scoring import fixed

    order = F.array_position(F.array(*[F.lit(m) for m in BENCHMARK_METRICS]), F.col("metric"))
    shown = lambda c, places: fixed(F.round(F.col(c), 9), places)  # noqa: E731  summation noise must not move a digit
    title = F.initcap(F.replace("metric", F.lit("_"), F.lit(" ")))
    advice = F.concat(
        F.lit("Focus on "), F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(": Currently at "), shown("percentile", 0),
        F.lit("th percentile (value: "), shown("value", 2), F.lit(" vs cohort avg: "), shown("cohort_mean", 2), F.lit(")"),
    )
    listed = lambda cond, text: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct(order.alias("o"), text.alias("t"))))), lambda s: s["t"]
    )
    weak = F.col("percentile") <= 25
    dqi = F.col("metric") == "dqi_score"
    out = bench.groupBy("site").agg(
        F.avg("percentile").alias("overall_percentile"),
        listed(F.col("percentile") >= 75, title).alias("strengths"),
        listed(weak, title).alias("weaknesses"),
        listed(weak, advice).alias("_advice"),
        F.max(F.when(dqi, F.col("rank_desc"))).alias("study_rank"),
        F.max(F.when(dqi, F.col("n"))).alias("study_total"),
    )
    # fixed value: the advice where nothing is weak
    fallback = F.array(F.lit("Maintain current performance levels"))
    return out.select(
        "site",
        "overall_percentile",
        performance_level(F.col("overall_percentile")).alias("overall_level"),
        "strengths",
        "weaknesses",
        F.when(F.size("_advice") > 0, F.slice("_advice", 1, 5)).otherwise(fallback).alias("recommendations"),
        "study_rank",
        "study_total",
    )


def study_summary(metrics: DataFrame, study: str = "study") -> DataFrame:
    """Sites, subjects, quality-index spread, five best and five worst sites per study."""
    sums = metrics.groupBy(study).agg(
        F.count(F.lit(1)).alias("site_count"),
        F.sum(F.coalesce("subject_count", F.lit(0))).alias("subject_count"),
        F.avg("dqi_score").alias("avg_site_dqi"),
        F.min("dqi_score").alias("min_site_dqi"),
        F.max("dqi_score").alias("max_site_dqi"),
        F.coalesce(F.stddev_samp("dqi_score"), F.lit(0.0)).alias("dqi_std"),
    )

    def ends(order, name):
        top = top_per_group(metrics.select(study, "site", "dqi_score"), [study], order, 5)
        return top.groupBy(study).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "site"))), lambda r: r["site"]).alias(name)
        )

    best = ends([F.desc("dqi_score"), F.asc("site")], "top_sites")
    worst = ends([F.asc("dqi_score"), F.desc("site")], "bottom_sites")
    out = sums.join(best, study, "left").join(worst, study, "left")
    enough = F.col("site_count") > 5
    return out.withColumn("bottom_sites", F.when(enough, F.reverse("bottom_sites")).otherwise(F.array().cast("array<string>")))


def study_metric_summary(metrics: DataFrame, study: str = "study") -> DataFrame:
    rows = metrics.unpivot([study], BENCHMARK_METRICS, "metric", "value")
    moments = rows.groupBy(study, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    medians = exact_quantiles(rows, [study, "metric"], "value", {"median": 0.5})
    return moments.join(medians, [study, "metric"])
