"""Scoring rules with hand-computed constants, and features on a two-site mock."""

import pytest
from pyspark.sql import functions as F

from trialgauge.functions import scoring as sc
from trialgauge.plans import features as ft
from trialgauge.plans import quality_index as qi


def scores(spark, values, mode="rules", baselines=None, cfg=None):
    base = {m: 0.0 for m in ft.METRICS} | values | {"site_id": "1"}
    df = spark.createDataFrame([base])
    cfg = cfg or sc.Config(mode=mode)
    rows = qi.metric_rows(qi.score_entities(df, "site_id", "site", cfg, baselines)).collect()
    return {r["name"]: r for r in rows}


def test_rule_constants(spark):
    low = scores(spark, {"missing_visits_pct": 0.01})["missing_visits_pct"]
    assert (low["status"], round(low["normalized_value"], 9)) == ("good", 0.9)
    high = scores(spark, {"missing_visits_pct": 0.25})["missing_visits_pct"]
    assert high["status"] == "critical" and high["normalized_value"] == pytest.approx(0.225)
    assert high["weight"] == pytest.approx(0.15 * 1.2)


@pytest.mark.parametrize(
    "value,expected,status",
    [(1.0, 1.0, "good"), (0.99, 0.9, "good"), (0.98, 0.8, "good"), (0.9, 0.8 - 0.5 * 0.08 / 0.18, "warning"), (0.4, 0.15, "critical"), (0.0, 0.0, "critical")],
)
def test_higher_is_better(spark, value, expected, status):
    row = scores(spark, {"meddra_coding_rate": value})["meddra_coding_rate"]
    assert row["normalized_value"] == pytest.approx(expected) and row["status"] == status


def stats_of(spark, values):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "site_id string, m double")
    return qi.baseline_map(ft.population_statistics(df, metrics=["m"]))


def test_percentile_and_z(spark):
    base = stats_of(spark, [1, 2, 3, 4, 5])
    df = spark.range(1).select(F.lit(3.0).alias("m"))
    row = df.select(F.expr(sc.z_score("m", base["m"])).alias("z"), F.expr(sc.interpolated_percentile("m", base["m"])).alias("p")).first()
    assert (row["z"], row["p"]) == (0.0, 50.0)


def test_degenerate_minimum_scores_25(spark):
    base = stats_of(spark, [0, 0, 0, 0])
    df = spark.range(1).select(F.lit(0.0).alias("m"))
    assert df.select(F.expr(sc.interpolated_percentile("m", base["m"]))).first()[0] == 25.0


def test_unknown_baseline_is_neutral(spark):
    row = scores(spark, {"missing_visits_pct": 0.3}, mode="statistical")["missing_visits_pct"]
    assert (row["z_score"], row["status"], row["normalized_value"]) == (None, "warning", 0.5)


def test_new_metric_threshold_defaults():
    cfg = sc.Config().with_thresholds({"extra": {"warning": 0.4}})
    rule = [r for r in cfg.rules if r.name == "extra"][0]
    assert (rule.good, rule.warning, rule.critical, rule.direction) == (0.0, 0.4, 1.0, sc.LOWER)


def test_weights_sum_to_one():
    cfg = sc.Config().with_weights({"safety_pending_pct": 2.0})
    assert sum(r.weight for r in cfg.rules) == pytest.approx(1.0)


def test_zero_weight_is_fifty(spark):
    cfg = sc.Config(rules=tuple(sc.MetricRule(m, weight=0.0) for m in ft.METRICS), mode="rules")
    df = spark.createDataFrame([{m: 0.0 for m in ft.METRICS} | {"site_id": "1"}])
    assert qi.score_entities(df, "site_id", "site", cfg).first()["score"] == 50.0


def test_config_and_baselines_round_trip(spark, tmp_path):
    cfg = sc.Config().with_weights({"safety_pending_pct": 0.4})
    qi.save_config(spark, cfg, str(tmp_path / "cfg"))
    assert qi.load_config(spark, str(tmp_path / "cfg")).rules == cfg.rules
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "site_id string, m double")
    qi.save_baselines(ft.population_statistics(df, metrics=["m"]), str(tmp_path / "base"))
    assert qi.load_baselines(spark, str(tmp_path / "base"))["m"]["p50"] == 1.5


def test_mock_site_features(spark):
    src = ft.Sources(
        visits=spark.createDataFrame([("1", 10.0), ("2", None), (None, 3.0)], "site string, days double"),
        safety=spark.createDataFrame([("1", "Pending"), ("2", None), ("2", "closed")], "site string, status string"),
        enrolment=spark.createDataFrame([("P1", "1", "a"), ("P2", "2", "a"), ("P1", "2", "b")], "subject string, site string, first_ord string"),
        issues=spark.createDataFrame([("P1", 5), ("P2", 0), ("P9", 7)], "subject string, issue_count long"),
    )
    rows = {r["site_id"]: r for r in ft.site_features(src).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["missing_visits_pct"] == 0.01 and rows["1"]["days_outstanding_avg"] == 10.0
    assert rows["2"]["days_outstanding_avg"] == 0.0  # a null day counts as zero
    assert (rows["1"]["safety_pending_pct"], rows["2"]["safety_pending_pct"]) == (1.0, 0.0)
    assert (rows["1"]["open_issues_per_subject"], rows["2"]["open_issues_per_subject"]) == (5.0, 0.0)
    assert rows["1"]["meddra_coding_rate"] == 0.99


def test_study_without_sites_gets_defaults(spark):
    feats = spark.createDataFrame([{m: 1.0 for m in ft.METRICS} | {"site_id": "s1"}])
    pairs = spark.createDataFrame([("A", "s1")], "study_id string, site string")
    studies = spark.createDataFrame([("A",), ("B",)], "study_id string")
    rows = {r["study_id"]: r for r in ft.study_features(feats, pairs, studies).collect()}
    assert rows["A"]["days_outstanding_avg"] == 1.0 and rows["B"]["days_outstanding_avg"] == 5.0
