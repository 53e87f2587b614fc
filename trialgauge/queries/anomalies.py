"""A: anomaly detection, control charts, drift."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import anomalies as an
from ..operators.neighbours import local_outlier_factor
from ..plans import clinical_views as cv
from ..plans import features as ft
from ..plans.staging import stage
from .book import Book
from .features import staged_features
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

M = ft.METRICS

define("q_pop", "SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM q_long GROUP BY metric")
define(
    "q_z",
    "SELECT entity_id, l.metric, value, mean, std, CASE WHEN std = 0 THEN 0.0 ELSE (value - mean) / std END AS z FROM q_long l JOIN q_pop p ON l.metric = p.metric",
)
define("q_ord", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(M)) + ") t(metric, ord)")
define("q_contrib", "SELECT entity_id, metric, value, ord, least(abs(z) / 3.0, 1.0) AS c FROM q_z JOIN q_ord USING (metric)")
define("q_stat", "SELECT entity_id, least(1.0, max(abs(z)) / 3.0) AS score FROM q_z GROUP BY entity_id")
define(
    "q_found",
    "SELECT entity_id AS site_id, score, score > 0 AS is_anomaly, CASE WHEN score >= 0.3 THEN 'Critical' WHEN score >= 0.2 THEN 'High' "
    "WHEN score >= 0.1 THEN 'Medium' ELSE 'Low' END AS risk_level FROM q_stat",
)
# a wider contribution limit spreads sites over all four levels
define(
    "q_spread",
    "SELECT site_id, score, CASE WHEN score >= 0.75 THEN 'Critical' WHEN score >= 0.6 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level FROM q_found",
)
define("q_anom", "SELECT entity_id AS site_id, metric, c, ord, value, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, ord) AS rn FROM q_contrib WHERE c >= 0.5")


def _found(spark, sf_dir):
    """Anomaly rows under the z-score method alone, which SQL can reproduce."""
    features = staged_features(spark, sf_dir)
    stats = an.feature_stats(features, M)
    scores = features.select(F.col("site_id").alias("id"))
    return stage(an.describe(features, scores, M, stats, "statistical"), "found")


def _spread(spark, sf_dir):
    s = F.col("anomaly_score")
    level = F.when(s >= 0.75, "Critical").when(s >= 0.6, "High").when(s >= 0.5, "Medium").otherwise("Low")
    return _found(spark, sf_dir).withColumn("risk_level", level)


def _points(spark, sf_dir, metrics=M):
    features = staged_features(spark, sf_dir)
    return stage(an.scaled_vectors(features, metrics, an.feature_stats(features, metrics)), "points")


@book.add("a01_standard_scaling", "SELECT entity_id AS id, metric, round(z, 5) AS scaled FROM q_z")
def a01(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in M])
    rows = _points(spark, sf_dir).select("id", F.posexplode("vec").alias("i", "x"))
    return rows.select("id", names[F.col("i")].alias("metric"), F.round("x", 5).alias("scaled"))


def _forest_sql(values: str, trees: int, dims: int) -> dict[str, str]:
    """Tables up to ``q_forest(id, score)`` that grow every tree level by level over ``values`` (id, xs)."""
    share = lambda what: f"('0x' || substr(md5('{an.SEED}:' || tree || ':' || way || ':{what}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    path = "CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END"
    ends = lambda f: "[" + ", ".join(f"{f}(xs[{j}]) FILTER (WHERE s) OVER w" for j in range(1, dims + 1)) + "]"
    depth = math.ceil(math.log2(an.SUBSAMPLE))
    out = {
        "q_fval": values,
        "q_f0": f"SELECT tree, id, xs, least({an.SUBSAMPLE}, count(*) OVER (PARTITION BY tree)) AS size, '' AS way, true AS live, "
        f"row_number() OVER (PARTITION BY tree ORDER BY md5('{an.SEED}:' || tree || ':' || id), id) <= {an.SUBSAMPLE} AS s FROM q_fval, range({trees}) AS t(tree)",
    }
    for i in range(depth):
        out[f"q_f{i + 1}"] = (
            "SELECT tree, id, xs, size, s, k IS NOT NULL AS live, "
            f"way || CASE WHEN k IS NULL THEN '' WHEN xs[k] <= lo[k] + {share('cut')} * (hi[k] - lo[k]) THEN 'l' ELSE 'r' END AS way FROM ("
            f"SELECT *, CASE WHEN live AND len(us) > 0 AND {i} < ceil(log2(greatest(2, size))) THEN us[1 + floor({share('dim')} * len(us))::INT] END AS k FROM ("
            f"SELECT *, list_filter(range(1, {dims + 1}), lambda j: hi[j] > lo[j]) AS us FROM ("
            f"SELECT *, {ends('min')} AS lo, {ends('max')} AS hi FROM q_f{i} WINDOW w AS (PARTITION BY tree, way)) a) b) c"
        )
    return out | {
        "q_leaf": f"SELECT id, size, length(way) + {path.format(n='n')} AS value FROM (SELECT id, size, way, count(*) FILTER (WHERE s) OVER (PARTITION BY tree, way) AS n FROM q_f{depth}) q",
        "q_raw": f"SELECT id, pow(2.0::DOUBLE, -(sum(value) / {trees}) / max({path.format(n='size')})) AS raw FROM q_leaf GROUP BY id",
        "q_forest": f"SELECT id, raw - (SELECT quantile_cont(raw, {1 - an.CONTAMINATION}::DOUBLE) FROM q_raw) AS score FROM q_raw",
    }


_SCALED = _forest_sql("SELECT entity_id AS id, list(z ORDER BY ord) AS xs FROM q_z JOIN q_ord USING (metric) GROUP BY entity_id", an.TREES, len(M))
_UNSCALED = _forest_sql(
    "SELECT site_id AS id, [" + ", ".join(f"{m}::DOUBLE" for m in an.LEGACY_FEATURES) + "] AS xs FROM q_feat", 100, len(an.LEGACY_FEATURES)
)


@book.add("a02_isolation_forest", "SELECT id, round(score, 6) AS score, score > 0 AS flagged FROM q_forest", **_SCALED)
def a02(spark, sf_dir):
    scored = an.isolation_scores(_points(spark, sf_dir))
    return scored.select("id", F.round("score", 6).alias("score"), (F.col("score") > 0).alias("flagged"))


@book.add(
    "a03_legacy_forest_bands",
    "SELECT id, round(score, 6) AS score, CASE WHEN score > 0.2 THEN 'Critical' WHEN score > 0.1 THEN 'High' WHEN score > 0 THEN 'Medium' ELSE 'Low' END AS level FROM q_forest",
    **_UNSCALED,
)
def a03(spark, sf_dir):
    # the older detector feeds unscaled features
    f = staged_features(spark, sf_dir)
    points = stage(f.select(F.col("site_id").alias("id"), F.array(*an.LEGACY_FEATURES).alias("vec")), "points")
    scored = an.isolation_scores(points, trees=100)
    return scored.select("id", F.round("score", 6).alias("score"), an.legacy_level(F.col("score")).alias("level"))


_LOF = {
    "q_kd": "SELECT a.entity_id AS a, b.entity_id AS b, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM q_z a JOIN q_z b ON a.metric = b.metric AND a.entity_id <> b.entity_id GROUP BY 1, 2",
    "q_kn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn, count(*) OVER (PARTITION BY a) AS n FROM q_kd) q WHERE rn <= least(20, n)",
    "q_kdist": "SELECT a, max(d) AS kd FROM q_kn GROUP BY a",
    "q_lrd": "SELECT n.a, 1.0 / (avg(greatest(n.d, k.kd)) + 1e-10) AS lrd FROM q_kn n JOIN q_kdist k ON n.b = k.a GROUP BY n.a",
    "q_lof": "SELECT n.a AS id, avg(p.lrd) / max(o.lrd) AS lof FROM q_kn n JOIN q_lrd p ON n.b = p.a JOIN q_lrd o ON n.a = o.a GROUP BY n.a",
}


@book.add("a04_local_outlier_factor", "SELECT id, round(lof, 5) AS lof FROM q_lof", **_LOF)
def a04(spark, sf_dir):
    points = _points(spark, sf_dir)
    return local_outlier_factor(points, min(an.LOF_NEIGHBOURS, points.count() - 1)).select("id", F.round("lof", 5).alias("lof"))


@book.add("a04_local_outlier_factor_many_leaves", "SELECT id, round(lof, 5) AS lof FROM q_lof", **_LOF)
def a04_leaves(spark, sf_dir):
    """The partitioned search, forced by small leaves on the same input."""
    points = _points(spark, sf_dir)
    k = min(an.LOF_NEIGHBOURS, points.count() - 1)
    return local_outlier_factor(points, k, leaf_rows=30).select("id", F.round("lof", 5).alias("lof"))


@book.add("a05_robust_mahalanobis")
def a05(spark, sf_dir):
    """Squared distance of every site under the fit of the best of many starts."""
    return an.robust_distances(_points(spark, sf_dir), len(M)).select("id", F.round("distance", 6).alias("distance"))


@book.add("a06_z_score_method", "SELECT entity_id AS site_id, round(score, 6) AS score FROM q_stat")
def a06(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    score = an.statistical_score(M, an.feature_stats(features, M))
    return features.select("site_id", F.round(score, 6).alias("score"))


@book.add(
    "a07_min_max_normalisation",
    "SELECT entity_id AS site_id, round((score - (SELECT min(score) FROM q_stat)) / ((SELECT max(score) - min(score) FROM q_stat) + 1e-10), 6) AS score FROM q_stat",
)
def a07(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    scored = features.select("site_id", an.statistical_score(M, an.feature_stats(features, M)).alias("score"))
    return an.normalised(stage(scored, "scores"), "score").withColumn("score", F.round("score", 6))


@book.add(
    "a08_ensemble_without_forest",
    "SELECT id AS site_id, round(0.3 * (lof - (SELECT min(lof) FROM q_lof)) / ((SELECT max(lof) - min(lof) FROM q_lof) + 1e-10) + 0.2 * score, 5) AS anomaly_score "
    "FROM q_lof JOIN q_stat ON id = entity_id",
    **_LOF,
)
def a08_two(spark, sf_dir):
    """Two of four methods; the weights still divide by their full sum."""
    features = staged_features(spark, sf_dir)
    stats = an.feature_stats(features, M)
    points = stage(an.scaled_vectors(features, M, stats), "points")
    lof = an.normalised(stage(local_outlier_factor(points, min(an.LOF_NEIGHBOURS, points.count() - 1)), "lof"), "lof")
    rows = an.describe(features, lof, M, stats)
    return rows.select("site_id", F.round("anomaly_score", 5).alias("anomaly_score"))


@book.add("a08_ensemble")
def a08(spark, sf_dir):
    """The four normalised parts of every site, their weighted sum and its level."""
    rows = an.detect(ft.view_site_features(spark, sf_dir), M)
    parts = [F.round(c, 6).alias(c) for c in ("isolation_forest", "lof", "statistical", "mahalanobis", "anomaly_score")]
    return rows.select("site_id", *parts, "is_anomaly", "risk_level")


@book.add("a09_flag_and_level", "SELECT site_id, is_anomaly, risk_level FROM q_found")
def a09(spark, sf_dir):
    return _found(spark, sf_dir).select("site_id", "is_anomaly", "risk_level")


@book.add("a10_feature_contributions", "SELECT entity_id AS site_id, metric, round(c, 6) AS contribution FROM q_contrib")
def a10(spark, sf_dir):
    rows = _found(spark, sf_dir).select("site_id", F.explode("contributions").alias("metric", "c"))
    return rows.select("site_id", "metric", F.round("c", 6).alias("contribution"))


@book.add("a11_anomalous_features", "SELECT site_id, string_agg(metric, ',' ORDER BY rn) AS features FROM q_anom GROUP BY site_id")
def a11(spark, sf_dir):
    return _found(spark, sf_dir).where(F.size("anomalous") > 0).select("site_id", F.concat_ws(",", "anomalous").alias("features"))


_SHOWN = "replace(metric, '_', ' ') || ': ' || CASE WHEN contains(metric, '_pct') THEN printf('%.1f', value * 100) || '%' ELSE printf('%.2f', value) END"


@book.add(
    "a12_explanation",
    "SELECT f.site_id, CASE WHEN t.txt IS NULL THEN 'Site ' || f.site_id || ' shows normal behavior across all metrics.' "
    "ELSE 'Site ' || f.site_id || ' is ' || risk_level || ' risk due to anomalous values in: ' || t.txt END AS explanation "
    f"FROM q_found f LEFT JOIN (SELECT site_id, string_agg({_SHOWN}, ', ' ORDER BY rn) AS txt FROM q_anom WHERE rn <= 3 GROUP BY site_id) t ON f.site_id = t.site_id",
)
def a12(spark, sf_dir):
    return _found(spark, sf_dir).select("site_id", "explanation")


_POP = ["mean", "std", "median", "q1", "q3", "min", "max"]


@book.add(
    "a13_population_stats",
    "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, "
    "round(quantile_cont(value, 0.75), 6) AS q3, round(min(value), 6) AS min, round(max(value), 6) AS max FROM q_long GROUP BY metric",
)
def a13(spark, sf_dir):
    s = an.population_stats(staged_features(spark, sf_dir), M)
    return s.select("metric", *[F.round(c, 6).alias(c) for c in _POP])


_CHART = (
    "SELECT entity_id AS site_id, metric, value, mean + 2 * std AS ucl, greatest(0.0, mean - 2 * std) AS lcl, mean + 3 * std AS usl, greatest(0.0, mean - 3 * std) AS lsl FROM q_z"
)


@book.add(
    "a14_control_chart",
    "SELECT site_id, metric, round(ucl, 6) AS ucl, round(lcl, 6) AS lcl, round(usl, 6) AS usl, round(lsl, 6) AS lsl, CASE WHEN value > usl THEN 'above_usl' WHEN value > ucl THEN 'above_ucl' "
    f"WHEN value < lsl THEN 'below_lsl' WHEN value < lcl THEN 'below_lcl' END AS violation FROM ({_CHART}) q",
)
def a14(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    charts = an.control_charts(features, M, an.feature_stats(features, M))
    return charts.select("site_id", "metric", *[F.round(c, 6).alias(c) for c in ("ucl", "lcl", "usl", "lsl")], "violation")


_HALF = "SELECT event_type AS feature, value, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS side FROM events"
_KS = {
    "q_side": _HALF,
    "q_step": "SELECT feature, value, count(*) FILTER (WHERE side = 'reference') AS r, count(*) FILTER (WHERE side = 'current') AS c FROM q_side GROUP BY 1, 2",
    "q_cdf": "SELECT feature, sum(r) OVER w * 1.0 / sum(r) OVER p AS fr, sum(c) OVER w * 1.0 / sum(c) OVER p AS fc, sum(r) OVER p AS nr, sum(c) OVER p AS nc FROM q_step "
    "WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)",
    "q_ks": "SELECT feature, max(abs(fr - fc))::DOUBLE AS statistic, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current FROM q_cdf GROUP BY feature",
    "q_exact": "SELECT feature, v[m + 1] AS p_exact FROM (WITH RECURSIVE dp AS (SELECT feature, n_reference AS m, n_current AS n, CAST(round(statistic * n_reference * n_current) AS BIGINT) AS steps, "
    "0::BIGINT AS k, list_transform(range(0, n_reference + 1), lambda i: 0.0::DOUBLE) AS v FROM q_ks UNION ALL SELECT feature, m, n, steps, k + 1, list_transform(range(0, m + 1), lambda i: "
    "CASE WHEN k + 1 - i < 0 OR k + 1 - i > n THEN 0.0::DOUBLE WHEN abs(i * n - (k + 1 - i) * m) >= steps THEN 1.0::DOUBLE "
    "ELSE CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE v[i] * i / (k + 1) END + v[i + 1] * (k + 1 - i) / (k + 1) END) FROM dp WHERE k < m + n) SELECT * FROM dp WHERE k = m + n) e",
    "q_kp": "SELECT *, (SELECT p_exact FROM q_exact x WHERE x.feature = q.feature) AS p_exact, (SELECT greatest(0.0, least(1.0, sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam)))) FROM range(1, 101) t(k)) AS p0 FROM "
    "(SELECT *, sqrt(n_reference * n_current * 1.0 / (n_reference + n_current)) * statistic AS lam FROM q_ks) q",
}


def _drift_rows(spark, sf_dir):
    side = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "reference").otherwise("current")
    return cv.table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "value", side.alias("side"))


_KS_SQL = "SELECT feature, round(statistic, 6) AS statistic, n_reference, n_current, round(p_exact, 6) AS p_value FROM q_kp"


def _ks_shown(df):
    return df.select("feature", F.round("statistic", 6).alias("statistic"), "n_reference", "n_current", F.round("p_value", 6).alias("p_value"))


@book.add("a15_ks_drift", _KS_SQL, **_KS)
def a15(spark, sf_dir):
    return _ks_shown(an.ks_two_sample(_drift_rows(spark, sf_dir)))


@book.add("a15_ks_drift_large_input_path", _KS_SQL.replace("p_exact", "CASE WHEN lam < 0.2 THEN 1.0 ELSE p0 END"), **_KS)
def a15_large(spark, sf_dir):
    """The law that holds for large samples, on the same input."""
    return _ks_shown(an.ks_two_sample(_drift_rows(spark, sf_dir), exact_size=0))


@book.add(
    "a16_drift_verdict",
    "SELECT d > 0 AS drift_detected, CASE WHEN d = 0 THEN NULL WHEN d > 2.5 THEN 'concept_drift' WHEN s > 0.3 THEN 'sudden_drift' ELSE 'gradual_drift' END AS drift_type, "
    "round(s, 6) AS drift_score, round(p, 6) AS p_value, d AS drifted FROM (SELECT count(*) FILTER (WHERE p1 < 0.05) AS d, avg(statistic) AS s, min(p1) AS p FROM "
    "(SELECT *, p_exact AS p1 FROM q_kp) q) z",
    **_KS,
)
def a16(spark, sf_dir):
    rows = _drift_rows(spark, sf_dir)
    seen = rows.select("feature").distinct().count()
    v = an.drift_verdict(an.ks_two_sample(rows), seen)
    return v.select("drift_detected", "drift_type", F.round("drift_score", 6).alias("drift_score"), F.round("p_value", 6).alias("p_value"), "drifted")


@book.add("a17_high_risk_filter", "SELECT site_id, risk_level FROM q_spread WHERE risk_level IN ('Critical', 'High', 'Medium')")
def a17(spark, sf_dir):
    return an.at_or_above(_spread(spark, sf_dir), "Medium").select("site_id", "risk_level")


@book.add("a17_level_top", "SELECT site_id, round(score, 6) AS score FROM q_spread WHERE risk_level = 'High' ORDER BY q_spread.score DESC, site_id LIMIT 5")
def a17_level(spark, sf_dir):
    return an.level_top(_spread(spark, sf_dir), "High", 5).select("site_id", F.round("anomaly_score", 6).alias("score"))


define("q_freq", "SELECT metric AS feature, count(*) AS n FROM q_anom GROUP BY metric")


@book.add(
    "a18_summary",
    "SELECT count(*) AS total_sites, count(*) FILTER (WHERE score > 0) AS anomaly_count, count(*) FILTER (WHERE risk_level = 'Critical') AS critical, "
    "count(*) FILTER (WHERE risk_level = 'High') AS high, count(*) FILTER (WHERE risk_level = 'Medium') AS medium, count(*) FILTER (WHERE risk_level = 'Low') AS low, "
    "round(count(*) FILTER (WHERE score > 0) * 1.0::DOUBLE / count(*), 6) AS anomaly_rate, "
    "(SELECT string_agg(feature, ',' ORDER BY n DESC, feature) FROM (SELECT * FROM q_freq ORDER BY n DESC, feature LIMIT 5) a) AS top_features, "
    "(SELECT string_agg(site_id, ',' ORDER BY score DESC, site_id) FROM (SELECT * FROM q_spread ORDER BY score DESC, site_id LIMIT 5) b) AS top_sites FROM q_spread",
)
def a18(spark, sf_dir):
    s = an.summary(stage(_spread(spark, sf_dir), "found"))
    return s.select(
        "total_sites", "anomaly_count", "critical", "high", "medium", "low", F.round("anomaly_rate", 6).alias("anomaly_rate"),
        F.concat_ws(",", "top_features").alias("top_features"), F.concat_ws(",", "top_sites").alias("top_sites"),
    )


@book.add(
    "a19_risk_distribution",
    "SELECT l.risk_level, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM q_found), 1) AS percent FROM "
    "(VALUES ('Critical'), ('High'), ('Medium'), ('Low')) l(risk_level) LEFT JOIN (SELECT risk_level, count(*) AS n FROM q_found GROUP BY 1) c ON l.risk_level = c.risk_level",
)
def a19(spark, sf_dir):
    return an.risk_distribution(_found(spark, sf_dir))


@book.add(
    "a20_feature_frequency",
    "SELECT feature, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM q_found), 1) AS percent, round(least(100.0, n * 100.0::DOUBLE / (SELECT max(n) FROM q_freq)), 6) AS bar "
    "FROM q_freq ORDER BY n DESC, feature LIMIT 6",
)
def a20(spark, sf_dir):
    return an.feature_frequency(_found(spark, sf_dir)).withColumn("bar", F.round("bar", 6))


@book.add(
    "a21_peers_at_level",
    "SELECT site_id, peer, rank FROM (SELECT a.site_id, b.site_id AS peer, row_number() OVER (PARTITION BY a.site_id ORDER BY b.score DESC, b.site_id) AS rank FROM q_spread a "
    "JOIN q_spread b ON a.risk_level = b.risk_level AND a.site_id <> b.site_id) q WHERE rank <= 5",
)
def a21(spark, sf_dir):
    return an.peers_at_level(_spread(spark, sf_dir)).select("site_id", "peer", "rank")


_ADVICE = "CASE " + " ".join(f"WHEN contains(metric, '{p}') THEN '{t}'" for p, t in an.FEATURE_ADVICE) + " END"


@book.add(
    "a22_recommendations",
    "SELECT f.site_id, coalesce(t, 'Continue routine monitoring') AS recommendations FROM q_found f LEFT JOIN "
    f"(SELECT site_id, string_agg({_ADVICE}, '; ' ORDER BY rn) AS t FROM q_anom WHERE rn <= 3 GROUP BY site_id) a ON f.site_id = a.site_id",
)
def a22(spark, sf_dir):
    return _found(spark, sf_dir).select("site_id", F.concat_ws("; ", an.recommendations(F.col("anomalous"))).alias("recommendations"))


@book.add(
    "a23_labels",
    "SELECT c.entity_id AS site_id, metric, CASE WHEN c >= 0.7 THEN 'critical' WHEN c >= 0.5 THEN 'high' WHEN c >= 0.3 THEN 'medium' ELSE 'low' END AS severity, "
    "CASE WHEN score >= 0.5 THEN 'Severe' WHEN score >= 0.3 THEN 'High' WHEN score >= 0.2 THEN 'Elevated' WHEN score >= 0.1 THEN 'Moderate' ELSE 'Normal' END AS label "
    "FROM q_contrib c JOIN q_stat s ON c.entity_id = s.entity_id",
)
def a23(spark, sf_dir):
    rows = _found(spark, sf_dir).select("site_id", "anomaly_score", F.explode("contributions").alias("metric", "c"))
    return rows.select("site_id", "metric", an.severity_label(F.col("c")).alias("severity"), an.score_label(F.col("anomaly_score")).alias("label"))


@book.add(
    "a24_feature_level_table",
    "SELECT metric AS feature, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{n}') AS \"{n}\"" for n, _ in an.LEVELS) + " FROM q_anom JOIN q_spread USING (site_id) GROUP BY metric",
)
def a24(spark, sf_dir):
    return an.feature_level_table(_spread(spark, sf_dir))


