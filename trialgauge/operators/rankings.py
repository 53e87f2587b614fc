"""Rankings: ordinal ranks, performers, leaderboards, portfolio summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import top_per_group, with_position

# Metric -> True when larger is better.
METRIC_DESCENDING: dict[str, bool] = {
    "dqi_score": True,
    "open_issues": False,
    "missing_visits_pct": False,
    "query_resolution_rate": True,
    "sdv_completion_pct": True,
    "enrollment_rate": True,
}

# Names under which a metric may be stored, in order of preference.
METRIC_ALIASES: dict[str, list[str]] = {
    "open_issues": ["open_issues", "total_issues", "open_issue_count"],
    "missing_visits_pct": ["missing_visits_pct", "missing_visits"],
    "query_resolution_rate": ["query_resolution_rate"],
    "sdv_completion_pct": ["sdv_completion_pct", "sdv_pct"],
    "enrollment_rate": ["enrollment_rate", "total_subjects"],
}


def percentile(rank: Column, total: Column) -> Column:
    return (total - rank + 1) / total * 100.0


def metric_value(df: DataFrame, metric: str, props: str | None = None) -> Column:
    """First alias of a metric that holds a number; from columns or a property map."""
    options = []
    for name in METRIC_ALIASES.get(metric, [metric]):
        if props is not None:
            options.append(F.try_element_at(F.col(props), F.lit(name)).try_cast("double"))
        elif name in df.columns:
            options.append(F.col(name).try_cast("double"))
    return F.coalesce(*options) if options else F.lit(None).cast("double")


def rank_entities(
    df: DataFrame,
    key: str,
    value: str,
    descending: bool = True,
    within: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """``key, value, rank, total, percentile``; ties by id, nulls dropped, limit last."""
    present = df.where(F.col(value).isNotNull()).select(*within, key, F.col(value).cast("double").alias("value"))
    order = [F.col("value").desc() if descending else F.col("value").asc(), F.col(key).asc()]
    ranked = with_position(present, order, within)
    ranked = ranked.withColumn("percentile", percentile(F.col("rank"), F.col("total")))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def performer_flags(ranked: DataFrame, count: Column | None = None) -> DataFrame:
    """Mark both ends of the whole ranking; a quarter of it unless ``count`` is given."""
    size = count if count is not None else F.greatest(F.lit(1), F.floor(F.col("total") / 4))
    return ranked.withColumns(
        {
            "is_top": F.col("rank") <= size,
            "is_bottom": (F.col("rank") > F.col("total") - size) & (F.col("total") > size),
        }
    )


def patient_performer_count() -> Column:
    return F.least(F.lit(5), F.col("total"))


def quartile_flags(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns(
        {"is_top_quartile": F.col("percentile") >= 75, "is_bottom_quartile": F.col("percentile") <= 25}
    )


def metric_long(df: DataFrame, key: str, metrics: Mapping[str, bool] = METRIC_DESCENDING) -> DataFrame:
    """Long rows with ``sort_value`` ascending from best to worst."""
    rows = df.unpivot([key], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    down = [m for m, d in metrics.items() if d]
    return rows.withColumn("sort_value", F.when(F.col("metric").isin(down), -F.col("value")).otherwise(F.col("value")))


def leaderboard(df: DataFrame, key: str, n: int = 10, metrics: Mapping[str, bool] = METRIC_DESCENDING) -> DataFrame:
    rows = metric_long(df, key, metrics)
    return top_per_group(rows, ["metric"], [F.asc("sort_value"), F.asc(key)], n).select("metric", key, "value", "rank")


def overall_leaderboard(
    df: DataFrame, key: str, metrics: Mapping[str, bool] = METRIC_DESCENDING
) -> DataFrame:
    """Mean rank over all metrics and the level it earns."""
    ranked = with_position(
        metric_long(df, key, metrics), [F.asc("sort_value"), F.asc(key)], ["metric"]
    )
    ranked = ranked.withColumn("percentile", percentile(F.col("rank"), F.col("total")))
    means = ranked.groupBy(key).agg(
        F.avg("rank").alias("avg_rank"),
        F.avg("percentile").alias("avg_percentile"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "rank")))).alias("metric_ranks"),
    )
    level = (
        F.when(F.col("avg_rank") <= 5, "top_performer").when(F.col("avg_rank") <= 15, "above_average").otherwise("average")
    )
    return means.withColumn("performance_level", level)


def percentile_histogram(ranked: DataFrame) -> DataFrame:
    p = F.col("percentile")
    return ranked.agg(
        F.count_if(p <= 25).alias("p0_25"),
        F.count_if((p > 25) & (p <= 50)).alias("p25_50"),
        F.count_if((p > 50) & (p <= 75)).alias("p50_75"),
        F.count_if(p > 75).alias("p75_100"),
    )


def health_label(score: Column) -> Column:
    return F.when(score >= 70, "Good").when(score >= 50, "Needs Attention").otherwise("Critical")


def portfolio_summary(ranked: DataFrame) -> DataFrame:
    """Totals, mean score, quartile counts, health, and the five sites at each end."""
    p = F.col("percentile")
    end = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "site"))))
    names = lambda rows: F.concat_ws(",", F.transform(rows, lambda r: r["site"]))
    sums = ranked.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.avg("value").alias("average_dqi"),
        F.count_if(p >= 75).alias("top_quartile_count"),
        F.count_if(p <= 25).alias("bottom_quartile_count"),
        end(F.col("rank") <= 5).alias("_top"),
        end(F.col("rank") > F.col("total") - 5).alias("_bottom"),
    )
    return sums.select(
        "total_sites",
        F.round("average_dqi", 1).alias("average_dqi"),
        "top_quartile_count",
        "bottom_quartile_count",
        health_label(F.col("average_dqi")).alias("health_label"),
        names(F.col("_top")).alias("top_sites"),
        names(F.reverse("_bottom")).alias("bottom_sites"),
    )


def underperformers(df: DataFrame, key: str, metric: str = "dqi_score", n: int = 10) -> DataFrame:
    """Worst ``n``: lowest quality index, or highest value of any other metric."""
    order = F.asc(metric) if metric in ("dqi_score", "dqi") else F.desc(metric)
    return df.select(key, metric).orderBy(order, F.asc(key)).limit(n)
