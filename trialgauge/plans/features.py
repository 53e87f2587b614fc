"""Site, subject and study features, and their population statistics.

Each source contributes narrow ``(site, counts, sums)`` rows. The contributions are
unioned and reduced by one ``groupBy(site)``: one shuffle in total, with the
per-site totals combined on the map side, and the site universe falls out of the
same aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import FEATURE_DEFAULTS, coded, status_contains
from . import clinical_views as cv
from .ordering import exact_quantiles

# The metrics in their order.
METRICS = [
    "missing_visits_pct",
    "missing_pages_pct",
    "open_issues_per_subject",
    "safety_pending_pct",
    "meddra_coding_rate",
    "whodd_coding_rate",
    "days_outstanding_avg",
    "days_pages_missing_avg",
]

VISIT_DENOMINATOR = 100
PAGE_DENOMINATOR = 50

# Features of a study without sites.
STUDY_DEFAULTS = {
    "missing_visits_pct": 0.05,
    "missing_pages_pct": 0.05,
    "open_issues_per_subject": 1.0,
    "safety_pending_pct": 0.10,
    "meddra_coding_rate": 0.99,
    "whodd_coding_rate": 0.99,
    "days_outstanding_avg": 5.0,
    "days_pages_missing_avg": 10.0,
}


@dataclass(frozen=True)
class Sources:
    """Clinical inputs under common names; any of them may be None.

    visits(site, days) · pages(site, days) · safety(site, status) · enrolment(subject,
    site, first_ord) · issues(subject, issue_count) · coding rates as plain numbers.
    """

    visits: DataFrame | None = None
    pages: DataFrame | None = None
    safety: DataFrame | None = None
    enrolment: DataFrame | None = None
    issues: DataFrame | None = None
    meddra_rate: float | None = None
    whodd_rate: float | None = None


def subject_sites(enrolment: DataFrame) -> DataFrame:
    """Subject -> site of its first safety record under the declared order."""
    return (
        enrolment.where(F.col("subject").isNotNull())
        .groupBy("subject")
        .agg(F.min(F.struct("first_ord", "site")).alias("f"))
        .select("subject", F.col("f.site").alias("site"))
    )


_PARTS = ["vis_n", "vis_days", "pag_n", "pag_days", "pag_days_n", "saf_n", "saf_pending", "iss_sum", "iss_n"]


def _contribution(df: DataFrame, **parts: Column) -> DataFrame:
    zero = F.lit(0.0)
    return df.where(F.col("site").isNotNull()).select(
        F.col("site").cast("string").alias("site_id"),
        F.lit(parts.pop("_universe", True)).alias("universe"),
        *[parts.get(p, zero).cast("double").alias(p) for p in _PARTS],
    )


def site_totals(src: Sources) -> DataFrame:
    days = F.coalesce(F.col("days"), F.lit(0.0))
    pieces = []
    if src.visits is not None:
        pieces.append(_contribution(src.visits, vis_n=F.lit(1.0), vis_days=days))
    if src.pages is not None:
        has_days = F.when(F.col("days").isNotNull(), 1.0).otherwise(0.0)
        pieces.append(_contribution(src.pages, pag_n=F.lit(1.0), pag_days=days, pag_days_n=has_days))
    if src.safety is not None:
        pending = F.when(status_contains(F.col("status"), "pending"), 1.0).otherwise(0.0)
        pieces.append(_contribution(src.safety, saf_n=F.lit(1.0), saf_pending=pending))
    if src.issues is not None and src.enrolment is not None:
        mapped = src.issues.join(subject_sites(src.enrolment), "subject")
        counted = F.when(F.col("issue_count").isNotNull(), 1.0).otherwise(0.0)
        pieces.append(
            _contribution(mapped, _universe=False, iss_sum=F.coalesce(F.col("issue_count"), F.lit(0)), iss_n=counted)
        )
    whole = reduce(DataFrame.unionByName, pieces)
    totals = whole.groupBy("site_id").agg(
        F.max("universe").alias("universe"), *[F.sum(p).alias(p) for p in _PARTS]
    )
    return totals.where("universe").drop("universe")


def _ratio(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(0.0)


def site_features(src: Sources, **options) -> DataFrame:
    """One row per site with the eight features."""
    return features_from_totals(site_totals(src), src, **options)


def features_from_totals(
    totals: DataFrame,
    src: Sources,
    visit_denominator: int = VISIT_DENOMINATOR,
    page_denominator: int = PAGE_DENOMINATOR,
    fill_null_days: bool = True,
) -> DataFrame:
    page_days = "pag_n" if fill_null_days else "pag_days_n"
    rates = {
        "meddra_coding_rate": FEATURE_DEFAULTS["meddra_coding_rate"] if src.meddra_rate is None else src.meddra_rate,
        "whodd_coding_rate": FEATURE_DEFAULTS["whodd_coding_rate"] if src.whodd_rate is None else src.whodd_rate,
    }
    return totals.select(
        "site_id",
        F.least(F.lit(1.0), F.col("vis_n") / F.lit(float(visit_denominator))).alias("missing_visits_pct"),
        F.least(F.lit(1.0), F.col("pag_n") / F.lit(float(page_denominator))).alias("missing_pages_pct"),
        _ratio("iss_sum", "iss_n").alias("open_issues_per_subject"),
        _ratio("saf_pending", "saf_n").alias("safety_pending_pct"),
        F.lit(float(rates["meddra_coding_rate"])).alias("meddra_coding_rate"),
        F.lit(float(rates["whodd_coding_rate"])).alias("whodd_coding_rate"),
        _ratio("vis_days", "vis_n").alias("days_outstanding_avg"),
        _ratio("pag_days", page_days).alias("days_pages_missing_avg"),
    )


def issues_per_subject_in_site(safety: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Per-site variant: mean over all subjects seen at the site; without issue
    counts, records per distinct subject."""
    if issues is None:
        return safety.where(F.col("site").isNotNull()).groupBy("site").agg(
            (F.count(F.lit(1)) / F.greatest(F.lit(1), F.countDistinct("subject"))).alias("open_issues_per_subject")
        )
    pairs = safety.where(F.col("site").isNotNull()).select("site", "subject").distinct()
    return pairs.join(issues, "subject").groupBy("site").agg(F.avg("issue_count").alias("open_issues_per_subject"))


def coding_rate(df: DataFrame, match: str = "word") -> DataFrame:
    """Share of coded terms of one coding table (a single row)."""
    return df.agg(F.avg(F.when(coded(F.col("coding_status"), match), 1.0).otherwise(0.0)).alias("coding_rate"))


def patient_features(issues: DataFrame, safety: DataFrame) -> DataFrame:
    """Every subject: first issue count and pending share; other metrics default.

    Equality on the subject id; a substring match would hand one subject's records to
    another ("Subject 1" inside "Subject 11").
    """
    first = issues.groupBy("subject").agg(
        F.min(F.struct("row_ord", "issue_count")).alias("f")
    ).select("subject", F.col("f.issue_count").cast("double").alias("open_issues_per_subject"))
    pending = safety.groupBy("subject").agg(
        F.avg(F.when(status_contains(F.col("status"), "pending"), 1.0).otherwise(0.0)).alias("safety_pending_pct")
    )
    both = first.join(pending, "subject", "full_outer")
    return both.select(
        F.col("subject").alias("patient_id"),
        *[
            F.coalesce(F.col(m), F.lit(FEATURE_DEFAULTS[m])).alias(m)
            if m in ("open_issues_per_subject", "safety_pending_pct")
            else F.lit(FEATURE_DEFAULTS[m]).alias(m)
            for m in METRICS
        ],
    )


def patients_matching(df: DataFrame, column: str, wanted: str, match: str = "exact") -> DataFrame:
    """Rows of one subject: exact id (default) or the looser containment test."""
    return df.where(F.col(column) == wanted) if match == "exact" else df.where(F.col(column).contains(wanted))


def study_features(features: DataFrame, study_site: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of a study's sites; a study without sites gets fixed values.

    The mean is held within the group's extremes: summing a constant must give the
    constant back, or a metric shared by all sites would land off its own baseline.
    """
    mean = lambda m: F.greatest(F.min(m), F.least(F.max(m), F.avg(m)))
    pairs = study_site.select("study_id", F.col("site").alias("site_id")).distinct()
    means = pairs.join(features, "site_id").groupBy("study_id").agg(*[mean(m).alias(m) for m in METRICS])
    if studies is not None:
        means = studies.select("study_id").distinct().join(means, "study_id", "left")
    return means.select("study_id", *[F.coalesce(F.col(m), F.lit(STUDY_DEFAULTS[m])).alias(m) for m in METRICS])


def unpivot(features: DataFrame, key: str = "site_id", metrics: list[str] = METRICS) -> DataFrame:
    return features.unpivot([key], metrics, "metric", "value")


def steady_deviation(value: str, deviation: Column) -> Column:
    """``deviation`` of a column; of a constant one exactly zero, which partial sums of many tasks may miss by an ulp."""
    return F.when(F.min(value) == F.max(value), deviation * 0.0).otherwise(deviation)


BASELINE_PROBS = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def population_statistics(
    features: DataFrame,
    key: str = "site_id",
    metrics: list[str] = METRICS,
    population_std: bool = False,
    single_std: float | None = 0.0,
) -> DataFrame:
    """Long table ``metric, mean, std, min, max, p25 … p95``; one row per metric.

    ``features`` should be staged. ``single_std`` replaces the undefined sample deviation of a single value.
    """
    rows = unpivot(features, key, metrics).where(F.col("value").isNotNull())
    std = steady_deviation("value", F.stddev_pop("value") if population_std else F.stddev_samp("value"))
    if not population_std and single_std is not None:
        std = F.when(F.count("value") > 1, std).otherwise(F.lit(single_std))
    moments = rows.groupBy("metric").agg(
        F.avg("value").alias("mean"), std.alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return moments.join(exact_quantiles(rows, ["metric"], "value", BASELINE_PROBS), "metric")


# ---- binding to the clinical views ----


def view_sources(spark: SparkSession, sf_dir: str, coding: str = "table") -> Sources:
    """Sources over the clinical views. ``coding='table'`` measures the two coding
    rates (two numbers come back); ``'default'`` keeps the constants."""
    rates: dict[str, float | None] = {"meddra_rate": None, "whodd_rate": None}
    if coding == "table":
        rows = coding_rates_by_dictionary(spark, sf_dir).collect()
        rates = {f"{r['dictionary']}_rate": r["coding_rate"] for r in rows}
    return Sources(
        visits=cv.visits(spark, sf_dir, ["site", "days_outstanding"]).withColumnRenamed("days_outstanding", "days"),
        pages=cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]).toDF("site", "days"),
        safety=cv.safety(spark, sf_dir, ["site", "review_status"]).toDF("site", "status"),
        enrolment=view_enrolment(spark, sf_dir),
        issues=view_issues(spark, sf_dir),
        **rates,
    )


def view_enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, site and the order in which the subject was seen there."""
    return cv.safety(spark, sf_dir, ["site", "patient_id", "created", "discrepancy_id"]).select(
        F.col("patient_id").alias("subject"), "site", F.concat_ws("|", "created", "discrepancy_id").alias("first_ord")
    )


def view_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue counts by subject, straight from the orders scan."""
    return (
        cv.table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "O")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("issue_count"))
        .select(F.concat(F.lit("Subject "), F.col("o_custkey").cast("string")).alias("subject"), "issue_count")
    )


def coding_rates_by_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coding rates in one pass: two rows."""
    part = cv.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = cv.table(spark, sf_dir, "lineitem").select("l_partkey", "l_tax")
    status = F.when(F.col("l_tax") >= 0.08, "UnCoded Term").otherwise("Coded Term")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .withColumn("coding_status", status)
        .groupBy(F.when(F.col("p_type").isin("ECONOMY", "MEDIUM"), "meddra").otherwise("whodd").alias("dictionary"))
        .agg(F.avg(F.when(coded(F.col("coding_status")), 1.0).otherwise(0.0)).alias("coding_rate"))
    )


def view_site_features(spark: SparkSession, sf_dir: str, coding: str = "table") -> DataFrame:
    return site_features(view_sources(spark, sf_dir, coding))
