"""Exploratory aggregates and the study metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences per non-null value, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return value_counts(df, column).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; nulls dropped."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    # bounds are two numbers: one aggregate row joined to every value
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("_k", F.lit(1))
    placed = values.withColumn("_k", F.lit(1)).join(F.broadcast(bounds), "_k")
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(0)
    return (
        placed.groupBy(bucket.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
        .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), "n")
    )


def mean_by(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias("mean"))


def sum_by(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(column).alias("total")).orderBy(F.desc("total"), F.asc(key))


def outer_on_study(*frames: DataFrame) -> DataFrame:
    """Full outer join on ``study``; absent numbers become zero."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, "study", "full_outer")
    return out.na.fill(0)


def study_metrics(issues: DataFrame, coding: DataFrame, safety: DataFrame, count: str = "total_open_issue_count_per_subject") -> DataFrame:
    """Issue totals, means and maxima with coding and safety record counts per study.

    Every input collapses to one row per study before the joins.
    """
    totals = issues.groupBy("study").agg(
        F.sum(count).alias("total_issues"), F.avg(count).alias("avg_issues"), F.max(count).alias("max_issues")
    )
    coded = coding.groupBy("study").agg(F.count(F.lit(1)).cast("double").alias("meddra_records"))
    events = safety.groupBy("study").agg(F.count(F.lit(1)).cast("double").alias("esae_records"))
    return outer_on_study(totals, coded, events)
