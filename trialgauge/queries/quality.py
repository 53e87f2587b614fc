"""Q: quality-index scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..plans import clinical_views as cv
from ..plans import features as ft
from ..plans import quality_index as qi
from .book import Book
from .features import long_sql, staged_features, view_patient_features, view_study_features
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

RULES = {r.name: r for r in sc.Config().rules}


def _config_sql(cfg: sc.Config) -> str:
    rows = ", ".join(
        f"('{r.name}', {i}, {r.good!r}::DOUBLE, {r.warning!r}::DOUBLE, {r.critical!r}::DOUBLE, '{r.direction}', {r.weight!r}::DOUBLE, "
        f"{r.multiplier!r}::DOUBLE, '{r.display}', '{sc.RECOMMENDATIONS.get(r.name, '')}')"
        for i, r in enumerate(cfg.rules)
    )
    return f"SELECT * FROM (VALUES {rows}) t(metric, ord, good, warning, critical, direction, weight, multiplier, display, template)"


define("q_cfg", _config_sql(sc.Config()))
define(
    "q_knots",
    "SELECT metric, val, pct, row_number() OVER (PARTITION BY metric ORDER BY val, ord) AS k FROM ("
    + " UNION ALL ".join(
        f"SELECT metric, {c} AS val, {p}.0::DOUBLE AS pct, {i} AS ord FROM q_baselines"
        for i, (c, p) in enumerate([("p25", 25), ("p50", 50), ("p75", 75), ("p90", 90), ("p95", 95), ("min", 0), ("max", 100)])
    )
    + ") q",
)
define(
    "q_segments",
    "SELECT metric, k, val AS x0, pct AS y0, lead(val) OVER (PARTITION BY metric ORDER BY k) AS x1, "
    "lead(pct) OVER (PARTITION BY metric ORDER BY k) AS y1 FROM q_knots",
)

_STATUS = (
    "CASE WHEN direction = 'lower_is_better' THEN CASE WHEN value <= good THEN 'good' WHEN value <= warning THEN 'warning' ELSE 'critical' END "
    "ELSE CASE WHEN value >= good THEN 'good' WHEN value >= warning THEN 'warning' ELSE 'critical' END END"
)
_NORM = (
    "CASE WHEN direction = 'lower_is_better' THEN CASE WHEN value <= 0 THEN 1.0::DOUBLE WHEN value <= good THEN 1.0 - 0.2 * (value / good) "
    "WHEN value <= critical THEN 0.8 - 0.5 * ((value - good) / (critical - good)) ELSE greatest(0.0, 0.3 - 0.3 * ((value - critical) / critical)) END "
    "ELSE CASE WHEN value >= 1 THEN 1.0::DOUBLE WHEN value >= good THEN 1.0 - 0.2 * ((1.0 - value) / (1.0 - good)) "
    "WHEN value >= critical THEN 0.8 - 0.5 * ((good - value) / (good - critical)) ELSE greatest(0.0, 0.3 * (value / critical)) END END"
)
_PSTATUS = (
    "CASE WHEN pct IS NULL THEN 'warning' WHEN direction = 'lower_is_better' THEN CASE WHEN pct <= 25 THEN 'good' WHEN pct <= 75 THEN 'warning' ELSE 'critical' END "
    "ELSE CASE WHEN pct >= 75 THEN 'good' WHEN pct >= 25 THEN 'warning' ELSE 'critical' END END"
)
_PNORM = "CASE WHEN pct IS NULL THEN 0.5::DOUBLE WHEN direction = 'lower_is_better' THEN 1.0 - pct / 100.0 ELSE pct / 100.0 END"


def define_scores(tag: str, long_table: str, cfg_table: str = "q_cfg") -> None:
    """Shared tables ``q_<tag>_metrics`` (all modes) and ``q_<tag>_<mode>`` results."""
    define(
        f"q_{tag}_pct",
        "SELECT l.entity_id, l.metric, l.value, c.*  EXCLUDE (metric), b.mean, b.std, CASE WHEN b.mean IS NULL THEN NULL WHEN b.std = 0 THEN 0.0::DOUBLE "
        "ELSE (l.value - b.mean) / b.std END AS z, "
        "CASE WHEN b.mean IS NULL THEN NULL WHEN l.value <= f.val THEN f.pct WHEN l.value >= t.val THEN t.pct ELSE "
        "(SELECT arg_min(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (l.value - x0) / (x1 - x0) * (y1 - y0) END, s.k) FROM q_segments s "
        "WHERE s.metric = l.metric AND l.value >= s.x0 AND l.value <= s.x1) END AS pct "
        f"FROM {long_table} l JOIN {cfg_table} c ON l.metric = c.metric LEFT JOIN q_baselines b ON l.metric = b.metric "
        "LEFT JOIN (SELECT * FROM q_knots WHERE k = 1) f ON l.metric = f.metric LEFT JOIN (SELECT * FROM q_knots WHERE k = 7) t ON l.metric = t.metric",
    )
    define(
        f"q_{tag}_base",
        f"SELECT *, {_STATUS} AS rstatus, {_NORM} AS rnorm, {_PSTATUS} AS sstatus, {_PNORM} AS snorm FROM q_{tag}_pct",
    )
    for mode, norm, status in (
        ("rules", "rnorm", "rstatus"),
        ("stat", "snorm", "sstatus"),
        ("hybrid", "rnorm * 0.6 + snorm * 0.4", "rstatus"),
    ):
        define(
            f"q_{tag}_{mode}_m",
            f"SELECT entity_id, metric, ord, value, z, pct, display, template, {norm} AS norm, {status} AS mstatus, "
            f"CASE WHEN {status} = 'critical' THEN weight * multiplier ELSE weight END AS w, "
            f"({norm}) * (CASE WHEN {status} = 'critical' THEN weight * multiplier ELSE weight END) * 100.0 AS contribution FROM q_{tag}_base",
        )
        define(
            f"q_{tag}_{mode}_s",
            "SELECT entity_id, CASE WHEN sum(w) = 0 THEN 50.0 ELSE least(100.0, greatest(0.0, sum(contribution) / sum(w))) END AS score, "
            "count(*) FILTER (WHERE mstatus = 'critical') AS critical_count, count(*) FILTER (WHERE mstatus = 'warning') AS warning_count "
            f"FROM q_{tag}_{mode}_m GROUP BY entity_id",
        )
        define(
            f"q_{tag}_{mode}",
            "SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade, "
            "CASE WHEN score >= 85 AND critical_count = 0 THEN 'Ready' WHEN score >= 60 AND critical_count <= 1 THEN 'At Risk' ELSE 'Critical' END AS status, "
            f"score >= 90 AND critical_count = 0 AS is_clean FROM q_{tag}_{mode}_s",
        )
        define(
            f"q_{tag}_{mode}_text",
            "SELECT s.entity_id, coalesce(t.issues, '') AS top_issues, coalesce(r.recs, '') AS recommendations "
            f"FROM q_{tag}_{mode}_s s LEFT JOIN (SELECT entity_id, "
            "string_agg(display || ': ' || printf('%.3f', value) || ' (' || mstatus || ')', '; ' ORDER BY rn) AS issues FROM "
            "(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE mstatus WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, -w, ord) AS rn "
            f"FROM q_{tag}_{mode}_m) a WHERE rn <= 5 AND mstatus <> 'good' GROUP BY entity_id) t ON s.entity_id = t.entity_id "
            "LEFT JOIN (SELECT entity_id, string_agg(replace(template, '{count}', CAST(CAST(trunc(value * 100) AS BIGINT) AS VARCHAR)), '; ' ORDER BY rn) AS recs FROM "
            "(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY contribution, ord) AS rn "
            f"FROM q_{tag}_{mode}_m WHERE mstatus <> 'good') b WHERE rn <= 3 GROUP BY entity_id) r ON s.entity_id = r.entity_id",
        )


define_scores("site", "q_long")
define("q_patient_long", long_sql("q_patient_feat", "patient_id"))
define_scores("patient", "q_patient_long")
define("q_study_long", long_sql("q_study_feat", "study_id"))
define_scores("study", "q_study_long")
define("q_rule_scores", "SELECT * FROM q_site_rules")

_RESULT = "entity_id, round(score, 4) AS score, grade, status, is_clean, critical_count, warning_count"


def result(scored):
    return scored.select(
        "entity_id", F.round("score", 4).alias("score"), "grade", "status", "is_clean", "critical_count", "warning_count"
    )


def site_baselines(features):
    return qi.baseline_map(ft.population_statistics(features))


def scored_sites(spark, sf_dir, mode="hybrid", cfg=None, features=None):
    cfg = cfg or sc.Config(mode=mode)
    if cfg.mode == "rules":
        rows = features if features is not None else ft.view_site_features(spark, sf_dir)
        return qi.score_entities(rows, "site_id", "site", cfg)
    features = features if features is not None else staged_features(spark, sf_dir)
    return qi.score_entities(features, "site_id", "site", cfg, site_baselines(features))


def at_risk_sites(spark, sf_dir):
    """Rule-based index of every site with its issues, worst first."""
    scored = scored_sites(spark, sf_dir, "rules")
    text = scored.select("*", F.concat_ws("; ", "top_issues").alias("why"))
    return text.select("entity_id", F.round("score", 4).alias("score"), "grade", "status", "critical_count", "why")


def _metric_rows(spark, sf_dir, mode):
    return qi.metric_rows(scored_sites(spark, sf_dir, mode))


@book.add("q00_at_risk_sites", "SELECT s.entity_id, round(score, 4) AS score, grade, status, critical_count, top_issues AS why FROM q_site_rules s JOIN q_site_rules_text t ON s.entity_id = t.entity_id")
def q00(spark, sf_dir):
    return at_risk_sites(spark, sf_dir)


@book.add("q01_rule_status", "SELECT entity_id, metric AS name, rstatus AS status FROM q_site_base")
def q01(spark, sf_dir):
    return _metric_rows(spark, sf_dir, "rules").select("entity_id", "name", "status")


@book.add("q02_rule_normalised", "SELECT entity_id, metric AS name, round(rnorm, 6) AS normalized_value FROM q_site_base")
def q02(spark, sf_dir):
    return _metric_rows(spark, sf_dir, "rules").select("entity_id", "name", F.round("normalized_value", 6).alias("normalized_value"))


@book.add(
    "q03_rule_score_rows",
    "SELECT entity_id, metric AS name, round(rnorm * 1.0 * 100, 4) AS contribution, rstatus AS status FROM q_site_base",
)
def q03(spark, sf_dir):
    """Unit weights, as for a scorer without a weight table."""
    unit = sc.Config(rules=tuple(sc.MetricRule(r.name, r.good, r.warning, r.critical, r.direction) for r in RULES.values()), mode="rules")
    rows = qi.metric_rows(scored_sites(spark, sf_dir, cfg=unit))
    return rows.select("entity_id", "name", F.round("contribution", 4).alias("contribution"), "status")


def _stat_rows(spark, sf_dir):
    return _metric_rows(spark, sf_dir, "statistical")


@book.add("q04_z_score", "SELECT entity_id, metric AS name, round(z, 5) AS z_score FROM q_site_base")
def q04(spark, sf_dir):
    return _stat_rows(spark, sf_dir).select("entity_id", "name", F.round("z_score", 5).alias("z_score"))


@book.add("q05_interpolated_percentile", "SELECT entity_id, metric AS name, round(pct, 5) AS percentile FROM q_site_base")
def q05(spark, sf_dir):
    return _stat_rows(spark, sf_dir).select("entity_id", "name", F.round("percentile", 5).alias("percentile"))


@book.add("q06_outlier_flag", "SELECT entity_id, metric AS name, abs(z) > 2.0 AS outlier FROM q_site_base")
def q06(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    base = site_baselines(features)
    flags = F.array(*[F.struct(F.lit(m).alias("name"), F.expr(sc.is_outlier(m, base.get(m))).alias("outlier")) for m in ft.METRICS])
    return features.select(F.col("site_id").alias("entity_id"), F.inline(flags))


@book.add("q07_percentile_status", "SELECT entity_id, metric AS name, sstatus AS status FROM q_site_base")
def q07(spark, sf_dir):
    return _stat_rows(spark, sf_dir).select("entity_id", "name", "status")


@book.add("q08_percentile_normalised", "SELECT entity_id, metric AS name, round(snorm, 6) AS normalized_value FROM q_site_base")
def q08(spark, sf_dir):
    return _stat_rows(spark, sf_dir).select("entity_id", "name", F.round("normalized_value", 6).alias("normalized_value"))


@book.add(
    "q09_statistical_score_rows",
    "SELECT entity_id, metric AS name, round(norm, 6) AS normalized_value, round(w, 6) AS weight, round(contribution, 4) AS contribution, mstatus AS status FROM q_site_stat_m",
)
def q09(spark, sf_dir):
    return _stat_rows(spark, sf_dir).select(
        "entity_id", "name", F.round("normalized_value", 6).alias("normalized_value"), F.round("weight", 6).alias("weight"),
        F.round("contribution", 4).alias("contribution"), "status",
    )


@book.add(
    "q10_hybrid_score_rows",
    "SELECT entity_id, metric AS name, round(norm, 6) AS normalized_value, mstatus AS status, round(z, 5) AS z_score, round(pct, 5) AS percentile FROM q_site_hybrid_m",
)
def q10(spark, sf_dir):
    return _metric_rows(spark, sf_dir, "hybrid").select(
        "entity_id", "name", F.round("normalized_value", 6).alias("normalized_value"), "status",
        F.round("z_score", 5).alias("z_score"), F.round("percentile", 5).alias("percentile"),
    )


@book.add(
    "q11_critical_multiplier",
    "SELECT entity_id, metric AS name, round(w, 6) AS weight, round(contribution, 4) AS contribution FROM q_site_rules_m WHERE mstatus = 'critical'",
)
def q11(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir, "rules").where(F.col("status") == "critical")
    return rows.select("entity_id", "name", F.round("weight", 6).alias("weight"), F.round("contribution", 4).alias("contribution"))


@book.add("q12_score", "SELECT entity_id, round(score, 4) AS score FROM q_site_hybrid")
def q12(spark, sf_dir):
    return result(scored_sites(spark, sf_dir)).select("entity_id", "score")


@book.add("q13_grade", "SELECT grade, count(*) AS sites FROM q_site_hybrid GROUP BY grade")
def q13(spark, sf_dir):
    return scored_sites(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("sites"))


@book.add("q14_status", "SELECT status, count(*) AS sites FROM q_site_hybrid GROUP BY status")
def q14(spark, sf_dir):
    return scored_sites(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("sites"))


@book.add("q15_counts_and_clean", "SELECT entity_id, critical_count, warning_count, is_clean FROM q_site_hybrid")
def q15(spark, sf_dir):
    return scored_sites(spark, sf_dir).select("entity_id", "critical_count", "warning_count", "is_clean")


@book.add("q16_top_issues", "SELECT entity_id, top_issues FROM q_site_hybrid_text")
def q16(spark, sf_dir):
    return scored_sites(spark, sf_dir).select("entity_id", F.concat_ws("; ", "top_issues").alias("top_issues"))


@book.add("q17_recommendations", "SELECT entity_id, recommendations FROM q_site_hybrid_text")
def q17(spark, sf_dir):
    return scored_sites(spark, sf_dir).select("entity_id", F.concat_ws("; ", "recommendations").alias("recommendations"))


_HEAVY = sc.Config(mode="rules").with_weights({"safety_pending_pct": 0.5})
define("q_cfg_heavy", _config_sql(_HEAVY))
define_scores("heavy", "q_long", "q_cfg_heavy")
_EQUAL = sc.Config(mode="rules").with_equal_weights()
define("q_cfg_equal", _config_sql(_EQUAL))
define_scores("equal", "q_long", "q_cfg_equal")


@book.add(
    "q18_weight_configuration",
    "SELECT h.entity_id, round(h.score, 4) AS heavy_safety, round(e.score, 4) AS equal_weights FROM q_heavy_rules h JOIN q_equal_rules e ON h.entity_id = e.entity_id",
)
def q18(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    heavy = scored_sites(spark, sf_dir, cfg=_HEAVY, features=features)
    equal = scored_sites(spark, sf_dir, cfg=_EQUAL, features=features)
    return heavy.select("entity_id", F.round("score", 4).alias("heavy_safety")).join(
        equal.select("entity_id", F.round("score", 4).alias("equal_weights")), "entity_id"
    )


_LOOSE = sc.Config(mode="rules").with_thresholds({"missing_pages_pct": {"good": 0.3, "warning": 0.5, "critical": 0.7}})
define("q_cfg_loose", _config_sql(_LOOSE))
define_scores("loose", "q_long", "q_cfg_loose")


@book.add("q19_threshold_configuration", f"SELECT {_RESULT} FROM q_loose_rules")
def q19(spark, sf_dir):
    return result(scored_sites(spark, sf_dir, cfg=_LOOSE))


@book.add("q20_sites_hybrid", f"SELECT {_RESULT} FROM q_site_hybrid")
def q20(spark, sf_dir):
    return result(scored_sites(spark, sf_dir))


@book.add("q20_sites_rules", f"SELECT {_RESULT} FROM q_site_rules")
def q20_rules(spark, sf_dir):
    return result(scored_sites(spark, sf_dir, "rules"))


@book.add("q20_sites_statistical", f"SELECT {_RESULT} FROM q_site_stat")
def q20_stat(spark, sf_dir):
    return result(scored_sites(spark, sf_dir, "statistical"))


@book.add("q20_patients_hybrid", f"SELECT {_RESULT} FROM q_patient_hybrid")
def q20_patients(spark, sf_dir):
    base = site_baselines(staged_features(spark, sf_dir))
    return result(qi.score_entities(view_patient_features(spark, sf_dir), "patient_id", "patient", sc.Config(), base))


@book.add("q20_studies_hybrid", f"SELECT {_RESULT} FROM q_study_hybrid")
def q20_studies(spark, sf_dir):
    features = staged_features(spark, sf_dir)
    base = site_baselines(features)
    from .features import study_sites, view_studies

    studies = ft.study_features(features, study_sites(spark, sf_dir), view_studies(spark, sf_dir))
    return result(qi.score_entities(studies, "study_id", "study", sc.Config(), base))


@book.add(
    "q20_selected_sites",
    f"SELECT {_RESULT} FROM q_site_rules WHERE entity_id IN (SELECT site FROM v_sites WHERE country IN ('NATION_3', 'NATION_7'))",
)
def q20_selected(spark, sf_dir):
    wanted = cv.sites(spark, sf_dir).where(F.col("country").isin("NATION_3", "NATION_7")).select(F.col("site").alias("site_id"))
    cfg = sc.Config(mode="rules")
    return result(qi.score_entities(ft.view_site_features(spark, sf_dir), "site_id", "site", cfg, only=wanted))


@book.add(
    "q21_result_row",
    "SELECT s.entity_id, 'site' AS entity_type, round(s.score, 2) AS score, s.grade, s.status, s.is_clean, s.critical_count, s.warning_count, 'stable' AS trend, "
    "(SELECT round(sum(round(contribution, 4)), 4) FROM q_site_hybrid_m m WHERE m.entity_id = s.entity_id) AS contributions, "
    "(SELECT count(*) FROM q_site_hybrid_m m WHERE m.entity_id = s.entity_id AND round(z, 2) <> 0) AS shown_z, "
    "CAST(NULL AS DOUBLE) AS population_percentile FROM q_site_hybrid s",
)
def q21(spark, sf_dir):
    rows = qi.display_rows(scored_sites(spark, sf_dir), null_zero=True)
    return rows.select(
        "entity_id", "entity_type", "score", "grade", "status", "is_clean", "critical_count", "warning_count",
        F.col("trend.direction").alias("trend"),
        F.round(sc.total(F.col("breakdown"), "contribution"), 4).alias("contributions"),
        F.size(F.filter("breakdown", lambda m: m["z_score"].isNotNull())).cast("long").alias("shown_z"),
        "population_percentile",
    )
