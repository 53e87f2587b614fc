"""A metric that all sites share has no deviation, however many tasks add it up."""

import pytest
from pyspark.sql import functions as F

from trialgauge.operators import anomalies as an
from trialgauge.plans import features as ft

SHARE = 0.9374033208732314


def shared(spark):
    # the counts leave one more rounding in the mean of each task
    rows = spark.range(0, 6000, 1, 7).where("id % 11 <> 3 OR id > 2500").select(F.col("id").cast("string").alias("site_id"), F.lit(SHARE).alias("rate"))
    return rows.withColumn("other", (F.col("site_id").cast("int") % 13).cast("double"))


def test_constant_metric_scales_to_zero(spark):
    rows = shared(spark)
    assert rows.agg(F.stddev_pop("rate")).first()[0] != 0.0  # as the engine adds it up
    stats = an.feature_stats(rows, ["rate", "other"])
    assert stats["rate"] == {"mean": pytest.approx(SHARE), "std": 0.0}
    assert stats["other"]["std"] > 0
    assert {r["vec"][0] for r in an.scaled_vectors(rows, ["rate", "other"], stats).collect()} == {0.0}


def test_constant_metric_has_no_deviation_in_the_baselines(spark):
    for table in (ft.population_statistics(shared(spark), metrics=["rate"]), an.population_stats(shared(spark), ["rate"])):
        row = table.first()
        assert (row["mean"], row["std"]) == (pytest.approx(SHARE), 0.0)
