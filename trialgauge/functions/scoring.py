"""Quality-index scoring as column expressions.

Everything a metric needs (thresholds, weights, baselines: a handful of numbers per
metric) is known when the plan is built, so scoring an entity is a projection over
its feature row: no unpivot, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = "lower_is_better"
HIGHER = "higher_is_better"

# Good, warning, critical, direction, weight, multiplier when critical.
DEFAULT_CONFIG: dict[str, tuple[float, float, float, str, float, float]] = {
    "missing_visits_pct": (0.02, 0.10, 0.20, LOWER, 0.15, 1.2),
    "missing_pages_pct": (0.05, 0.15, 0.25, LOWER, 0.12, 1.0),
    "open_issues_per_subject": (1.0, 3.0, 5.0, LOWER, 0.18, 1.3),
    "safety_pending_pct": (0.05, 0.15, 0.30, LOWER, 0.18, 1.5),
    "meddra_coding_rate": (0.98, 0.90, 0.80, HIGHER, 0.08, 1.0),
    "whodd_coding_rate": (0.98, 0.90, 0.80, HIGHER, 0.07, 1.0),
    "days_outstanding_avg": (7.0, 30.0, 60.0, LOWER, 0.12, 1.0),
    "days_pages_missing_avg": (14.0, 45.0, 90.0, LOWER, 0.10, 1.0),
}

# Recommendation text per metric; {count} is the value times 100.
RECOMMENDATIONS: dict[str, str] = {
    "missing_visits_pct": "Follow up on {count} overdue visits to improve visit compliance",
    "missing_pages_pct": "Resolve missing CRF pages to ensure complete data collection",
    "open_issues_per_subject": "Address open data queries to reduce issue backlog",
    "safety_pending_pct": "URGENT: Clear pending safety reviews immediately",
    "meddra_coding_rate": "Complete MedDRA coding for uncoded adverse events",
    "whodd_coding_rate": "Complete WHODD coding for uncoded medications",
    "days_outstanding_avg": "Reduce visit delays through proactive site follow-up",
    "days_pages_missing_avg": "Expedite resolution of aged missing pages",
}

# Grade floors, status floors, shares of the two scores in a hybrid one, outlier limit.
GRADES = [("A", 90.0), ("B", 75.0), ("C", 60.0), ("D", 45.0), ("F", 0.0)]
READY, AT_RISK, CLEAN = 85.0, 60.0, 90.0
RULE_SHARE, STAT_SHARE = 0.6, 0.4
OUTLIER_Z = 2.0


@dataclass(frozen=True)
class MetricRule:
    name: str
    good: float = 0.0
    warning: float = 0.5
    critical: float = 1.0
    direction: str = LOWER
    weight: float = 1.0
    multiplier: float = 1.0
    known: bool = True

    @property
    def display(self) -> str:
        return self.name.replace("_", " ").title()


@dataclass(frozen=True)
class Config:
    rules: tuple[MetricRule, ...] = field(default_factory=lambda: tuple(MetricRule(m, *v) for m, v in DEFAULT_CONFIG.items()))
    mode: str = "hybrid"
    rule_share: float = RULE_SHARE
    stat_share: float = STAT_SHARE
    ready: float = READY
    at_risk: float = AT_RISK

    def with_weights(self, overrides: Mapping[str, float] | None = None, normalise: bool = True) -> "Config":
        """Override weights, then scale them to sum to one."""
        overrides = overrides or {}
        rules = [replace(r, weight=float(overrides.get(r.name, r.weight))) for r in self.rules]
        total = sum(r.weight for r in rules)
        if normalise and total > 0:
            rules = [replace(r, weight=r.weight / total) for r in rules]
        return replace(self, rules=tuple(rules))

    def with_equal_weights(self) -> "Config":
        share = 1.0 / len(self.rules)
        return replace(self, rules=tuple(replace(r, weight=share) for r in self.rules))

    def with_thresholds(self, overrides: Mapping[str, Mapping[str, float | str]]) -> "Config":
        """Partial overrides; an unseen metric starts from 0 / 0.5 / 1, lower is better."""
        rules = {r.name: r for r in self.rules}
        for name, change in overrides.items():
            rules[name] = replace(rules.get(name, MetricRule(name)), **change)
        return replace(self, rules=tuple(rules.values()))


# The per-metric rules below return SQL text. A score row is built from a few hundred
# operators; one parsed expression is far cheaper to plan than as many Column calls.


def _num(x: float) -> str:
    return f"{float(x)!r}D"


def rule_status(v: str, rule: MetricRule) -> str:
    if not rule.known:
        return "'good'"
    sign = "<=" if rule.direction == LOWER else ">="
    return (
        f"CASE WHEN {v} {sign} {_num(rule.good)} THEN 'good' WHEN {v} {sign} {_num(rule.warning)} THEN 'warning' "
        "ELSE 'critical' END"
    )


def rule_normalised(v: str, rule: MetricRule) -> str:
    """Piecewise linear quality in [0, 1]; 0.8 at the good bound, 0.3 at the critical one."""
    if not rule.known:
        return "0.5D"
    g, c = _num(rule.good), _num(rule.critical)
    if rule.direction == LOWER:
        return (
            f"CASE WHEN {v} <= 0 THEN 1D WHEN {v} <= {g} THEN 1D - 0.2D * try_divide({v}, {g}) "
            f"WHEN {v} <= {c} THEN 0.8D - 0.5D * try_divide({v} - {g}, {c} - {g}) "
            f"ELSE greatest(0D, 0.3D - 0.3D * try_divide({v} - {c}, {c})) END"
        )
    return (
        f"CASE WHEN {v} >= 1 THEN 1D WHEN {v} >= {g} THEN 1D - 0.2D * try_divide(1D - {v}, 1D - {g}) "
        f"WHEN {v} >= {c} THEN 0.8D - 0.5D * try_divide({g} - {v}, {g} - {c}) "
        f"ELSE greatest(0D, 0.3D * try_divide({v}, {c})) END"
    )


Baseline = Mapping[str, float]


def z_score(v: str, base: Baseline | None) -> str:
    if base is None:
        return "CAST(NULL AS DOUBLE)"
    if not base["std"]:
        return "0D"
    return f"(({v} - {_num(base['mean'])}) / {_num(base['std'])})"


def is_outlier(v: str, base: Baseline | None, limit: float = OUTLIER_Z) -> str:
    return "false" if base is None else f"abs({z_score(v, base)}) > {_num(limit)}"


def interpolated_percentile(v: str, base: Baseline | None) -> str:
    """Percentile read off the baseline knots.

    Knots are sorted by value and stay in listed order when equal, so a metric whose
    25th percentile equals its minimum scores 25 at the minimum.
    """
    if base is None:
        return "CAST(NULL AS DOUBLE)"
    knots = [(base[f"p{p}"], float(p)) for p in (25, 50, 75, 90, 95)] + [(base["min"], 0.0), (base["max"], 100.0)]
    knots.sort(key=lambda k: k[0])
    arms = [
        f"WHEN {v} <= {_num(knots[0][0])} THEN {_num(knots[0][1])}",
        f"WHEN {v} >= {_num(knots[-1][0])} THEN {_num(knots[-1][1])}",
    ]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        line = _num(y0) if x0 == x1 else f"{_num(y0)} + ({v} - {_num(x0)}) / {_num(x1 - x0)} * {_num(y1 - y0)}"
        arms.append(f"WHEN {v} >= {_num(x0)} AND {v} <= {_num(x1)} THEN {line}")
    return f"CASE {' '.join(arms)} ELSE 50D END"


def percentile_status(p: str, direction: str) -> str:
    sign, good, warning = ("<=", 25, 75) if direction == LOWER else (">=", 75, 25)
    return (
        f"CASE WHEN {p} IS NULL THEN 'warning' WHEN {p} {sign} {good} THEN 'good' WHEN {p} {sign} {warning} THEN 'warning' "
        "ELSE 'critical' END"
    )


def percentile_normalised(p: str, direction: str) -> str:
    share = f"1D - {p} / 100D" if direction == LOWER else f"{p} / 100D"
    return f"coalesce({share}, 0.5D)"


def score_projections(
    rules: Sequence[MetricRule], baselines: Mapping[str, Baseline], cfg: Config
) -> list[list[str]]:
    """Successive projections from metric columns to a ``breakdown`` array column.

    Each level names what the next one uses more than once, so no expression is
    evaluated twice. The last level is one
    ``struct(name, raw_value, normalized_value, weight, contribution, status, z_score,
    percentile)`` per metric.
    """
    if cfg.mode not in ("rules", "statistical", "hybrid"):
        raise ValueError(f"unknown scoring mode {cfg.mode!r}")
    null = "CAST(NULL AS DOUBLE)"
    read, judge, weigh, structs = [], [], [], []
    for i, r in enumerate(rules):
        base, v = baselines.get(r.name), f"v{i}"
        read.append(f"CAST(`{r.name}` AS DOUBLE) AS {v}")
        by_rule = cfg.mode == "rules"
        judge += [
            f"{null if by_rule else interpolated_percentile(v, base)} AS p{i}",
            f"{null if by_rule else z_score(v, base)} AS z{i}",
            f"{rule_normalised(v, r)} AS r{i}",
        ]
        stat = percentile_normalised(f"p{i}", r.direction)
        norm = {"rules": f"r{i}", "statistical": stat, "hybrid": f"r{i} * {_num(cfg.rule_share)} + ({stat}) * {_num(cfg.stat_share)}"}
        status = percentile_status(f"p{i}", r.direction) if cfg.mode == "statistical" else rule_status(v, r)
        weigh += [f"{norm[cfg.mode]} AS n{i}", f"{status} AS s{i}"]
        structs.append(
            f"struct('{r.name}' AS name, {v} AS raw_value, n{i} AS normalized_value, w{i} AS weight, "
            f"n{i} * w{i} * 100D AS contribution, s{i} AS status, z{i} AS z_score, p{i} AS percentile)"
        )
    weights = [
        f"CASE WHEN s{i} = 'critical' THEN {_num(r.weight * r.multiplier)} ELSE {_num(r.weight)} END AS w{i}"
        for i, r in enumerate(rules)
    ]
    return [read, judge, weigh, weights, [f"array({', '.join(structs)}) AS breakdown"]]


def total(breakdown: Column, part: str) -> Column:
    return F.aggregate(breakdown, F.lit(0.0), lambda acc, m: acc + m[part])


def overall_score(breakdown: Column) -> Column:
    weight = total(breakdown, "weight")
    share = F.try_divide(total(breakdown, "contribution"), weight)
    return F.when(weight == 0, 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)))


def status_count(breakdown: Column, status: str) -> Column:
    return F.size(F.filter(breakdown, lambda m: m["status"] == status)).cast("long")


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for label, floor in GRADES[1:]:
        out = out.when(score >= floor, label)
    return out.otherwise("F")


def readiness(score: Column, critical: Column, ready: float = READY, at_risk: float = AT_RISK) -> Column:
    return (
        F.when((score >= ready) & (critical == 0), "Ready")
        .when((score >= at_risk) & (critical <= 1), "At Risk")
        .otherwise("Critical")
    )


def fixed(v: Column, places: int) -> Column:
    """Fixed-point text, ties on the exact binary value (no thousands separator)."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", v, F.lit(pattern))


def _lookup(rules: Sequence[MetricRule], value) -> str:
    return "map(" + ", ".join(f"'{r.name}', {value(i, r)}" for i, r in enumerate(rules)) + ")"


def top_issues(rules: Sequence[MetricRule], limit: int = 5) -> Column:
    """Worst statuses first, heavier first; five are taken, then good ones dropped.
    Reads the ``breakdown`` column."""
    names, order = _lookup(rules, lambda i, r: f"'{r.display}'"), _lookup(rules, lambda i, r: i)
    ranked = (
        "array_sort(transform(breakdown, m -> struct(CASE m.status WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS p, "
        f"-m.weight AS w, {order}[m.name] AS o, m.name AS n, m.raw_value AS v, m.status AS s)))"
    )
    return F.expr(
        f"transform(filter(slice({ranked}, 1, {limit}), x -> x.s <> 'good'), "
        f"x -> concat({names}[x.n], ': ', format_number(x.v, '0.000'), ' (', x.s, ')'))"
    )


def recommendations(rules: Sequence[MetricRule], limit: int = 3) -> Column:
    """Templates of critical and warning metrics, smallest contribution first.
    Reads the ``breakdown`` column."""
    rules = [r for r in rules if r.name in RECOMMENDATIONS]
    text, order = _lookup(rules, lambda i, r: f"'{RECOMMENDATIONS[r.name]}'"), _lookup(rules, lambda i, r: i)
    ranked = (
        "array_sort(transform(filter(breakdown, m -> m.status IN ('critical', 'warning')), "
        f"m -> struct(m.contribution AS c, {order}[m.name] AS o, m.name AS n, m.raw_value AS v)))"
    )
    return F.expr(
        f"transform(slice({ranked}, 1, {limit}), "
        f"x -> replace({text}[x.n], '{{count}}', CAST(CAST(x.v * 100 AS BIGINT) AS STRING)))"
    )
