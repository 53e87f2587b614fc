"""The benchmark metric vector of every site over the clinical views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..operators.benchmarks import site_metric_vector
from . import clinical_views as cv
from . import features as ft
from . import quality_index as qi
from .staging import kept, stage


def view_site_metrics(spark: SparkSession, sf_dir: str, mode: str = "hybrid") -> DataFrame:
    """``site, study, country, region, grade, subject_count`` and seven metrics; materialised
    once per input."""
    return kept(spark, f"site-metrics-{mode}", cv.source_paths(sf_dir), lambda: _site_metrics(spark, sf_dir, mode))


def _site_metrics(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    src = ft.view_sources(spark, sf_dir)
    totals = stage(ft.site_totals(src), "totals")
    features = stage(ft.features_from_totals(totals, src), "features")
    base = {} if mode == "rules" else qi.baseline_map(ft.population_statistics(features))
    scored = qi.score_entities(features, "site_id", "site", sc.Config(mode=mode), base)
    known = scored.select(F.col("entity_id").alias("site"), F.col("score").alias("dqi_score"), "grade")
    properties = features.select(
        F.col("site_id").alias("site"), "missing_visits_pct", (1.0 - F.col("safety_pending_pct")).alias("safety_review_rate")
    ).join(totals.select(F.col("site_id").alias("site"), F.col("iss_sum").alias("open_issues")), "site").join(known, "site")
    master = cv.site_master(spark, sf_dir)
    vector = site_metric_vector(
        master.select("site", "study", "country", "region"), master.select("site", "subject_count"), properties.drop("grade")
    )
    return stage(vector.join(known.select("site", "grade"), "site", "left"), "site-metrics")
