"""Quality index of sites, subjects and studies: features -> score row per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..sources import readers, writers

Baselines = dict[str, dict[str, float]]


def baseline_map(stats: DataFrame) -> Baselines:
    """Population statistics as plain numbers: one row per metric comes back."""
    return {r["metric"]: {k: r[k] for k in r.asDict() if k != "metric"} for r in stats.collect()}


def score_entities(
    features: DataFrame,
    key: str,
    entity_type: str,
    cfg: sc.Config | None = None,
    baselines: Baselines | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Score every entity of ``features``; ``only`` restricts to a table of ids."""
    cfg = cfg or sc.Config()
    baselines = baselines or {}
    if only is not None:
        features = features.join(only.select(key), key, "left_semi")
    rules = [r for r in cfg.rules if r.name in features.columns]
    scored = features.select(F.col(key).alias("entity_id"), F.lit(entity_type).alias("entity_type"), *[r.name for r in rules])
    for level in sc.score_projections(rules, baselines, cfg):
        scored = scored.selectExpr("*", *level)
    scored = scored.select("entity_id", "entity_type", "breakdown")
    scored = scored.withColumns(
        {
            "score": sc.overall_score(F.col("breakdown")),
            "critical_count": sc.status_count(F.col("breakdown"), "critical"),
            "warning_count": sc.status_count(F.col("breakdown"), "warning"),
        }
    )
    return scored.select(
        "entity_id",
        "entity_type",
        "score",
        sc.grade(F.col("score")).alias("grade"),
        sc.readiness(F.col("score"), F.col("critical_count"), cfg.ready, cfg.at_risk).alias("status"),
        ((F.col("score") >= sc.CLEAN) & (F.col("critical_count") == 0)).alias("is_clean"),
        "critical_count",
        "warning_count",
        "breakdown",
        F.struct(F.lit("stable").alias("direction"), F.lit(0.0).alias("change_percent")).alias("trend"),
        sc.recommendations(rules).alias("recommendations"),
        sc.top_issues(rules).alias("top_issues"),
        F.lit(None).cast("double").alias("population_percentile"),
    )


def metric_rows(scored: DataFrame) -> DataFrame:
    """One row per entity and metric.

    The array is never empty; the outer form keeps the optimizer from guarding the
    explode with a filter that repeats the whole scoring expression.
    """
    return scored.select("entity_id", F.explode_outer("breakdown").alias("m")).select("entity_id", "m.*")


def display_rows(scored: DataFrame, null_zero: bool = False) -> DataFrame:
    """Rounded result rows. ``null_zero`` blanks a z-score or percentile of exactly zero."""

    def shown(col, places):
        out = F.round(col, places)
        return F.nullif(out, F.lit(0.0)) if null_zero else out

    rounded = F.transform(
        "breakdown",
        lambda m: F.struct(
            m["name"].alias("name"),
            F.round(m["raw_value"], 4).alias("raw_value"),
            F.round(m["normalized_value"], 4).alias("normalized_value"),
            F.round(m["weight"], 4).alias("weight"),
            F.round(m["contribution"], 4).alias("contribution"),
            m["status"].alias("status"),
            shown(m["z_score"], 2).alias("z_score"),
            shown(m["percentile"], 2).alias("percentile"),
        ),
    )
    return scored.withColumns({"breakdown": rounded, "score": F.round("score", 2)})


def save_baselines(stats: DataFrame, path: str) -> None:
    writers.save_statistics(stats, path)


def load_baselines(spark: SparkSession, path: str) -> Baselines:
    return baseline_map(readers.run_sql(spark, f"SELECT * FROM parquet.`{path}`"))


def save_config(spark: SparkSession, cfg: sc.Config, path: str) -> None:
    """Scoring configuration as a one-row-per-metric JSON table."""
    rows = [(r.name, r.good, r.warning, r.critical, r.direction, r.weight, r.multiplier) for r in cfg.rules]
    schema = "name string, good double, warning double, critical double, direction string, weight double, multiplier double"
    spark.createDataFrame(rows, schema).write.mode("overwrite").json(path)


def load_config(spark: SparkSession, path: str, mode: str = "hybrid") -> sc.Config:
    schema = "name string, good double, warning double, critical double, direction string, weight double, multiplier double"
    names = list(sc.DEFAULT_CONFIG)
    rows = sorted(
        spark.read.schema(schema).json(path).collect(),
        key=lambda r: (names.index(r["name"]) if r["name"] in names else len(names), r["name"]),
    )
    return sc.Config(rules=tuple(sc.MetricRule(**r.asDict()) for r in rows), mode=mode)
