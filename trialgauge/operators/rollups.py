"""Report tables: site, study, portfolio, region and trial rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import top_per_group
from .joins import attach_scalars

DEFAULT_DQI = 70.0


def site_summary(metrics: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Subjects, issues, score, grade and, when given, benchmark standing per site."""
    rows = metrics.select(
        F.col("site").alias("site_id"), F.col("subject_count").alias("total_subjects"), F.col("open_issues").cast("long").alias("open_issues"),
        "dqi_score", "grade",
    )
    if bench is None:
        return rows
    return rows.join(bench.select(F.col("site").alias("site_id"), "overall_percentile", "overall_level", "study_rank", "study_total"), "site_id", "left")


def study_overview(metrics: DataFrame, study: str = "study") -> DataFrame:
    """Sites, issues and the ten best sites per study."""
    sums = metrics.groupBy(study).agg(F.count(F.lit(1)).alias("total_sites"), F.sum("open_issues").cast("long").alias("total_issues"))
    best = top_per_group(metrics.select(study, "site", "dqi_score"), [study], [F.desc("dqi_score"), F.asc("site")], 10)
    names = best.groupBy(study).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "site"))), lambda r: r["site"]).alias("top_sites")
    )
    return sums.join(names, study)


def portfolio_digest(metrics: DataFrame, subjects: DataFrame) -> DataFrame:
    totals = metrics.agg(F.count(F.lit(1)).alias("total_sites"), F.sum("open_issues").cast("long").alias("total_open_issues"))
    people = subjects.agg(F.countDistinct("subject").alias("total_subjects"))
    return attach_scalars(totals, people)


# The bands and texts of the two functions below.
def issue_band(issues: Column) -> Column:
    return (
        F.when(issues == 0, "No open issues. Site is in good standing.")
        .when(issues < 10, "Minor attention required.")
        .when(issues < 50, "Moderate intervention recommended.")
        .otherwise("Immediate attention required.")
    )


def report_recommendations(issues: Column, dqi: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(issues > 50, "Prioritize issue resolution - schedule dedicated data cleaning sessions").when(
                issues > 20, "Review and categorize open issues for efficient resolution"
            ),
            F.when(dqi < 60, "Conduct detailed data quality review to identify root causes"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Maintain current monitoring practices")))


def _dqi() -> Column:
    return F.coalesce("dqi_score", F.lit(DEFAULT_DQI))


def region_rollup(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(F.coalesce("region", F.lit("Unknown")).alias("region")).agg(
        F.count(F.lit(1)).alias("sites_count"), F.sum(F.coalesce("subject_count", F.lit(0))).alias("total_patients"), F.avg(_dqi()).alias("avg_dqi")
    )


def timeline_risk(dqi: Column) -> Column:
    return F.when(dqi >= 85, 5).when(dqi >= 70, 15).when(dqi >= 55, 30).otherwise(50)


def trial_metrics(metrics: DataFrame, open_queries: DataFrame) -> DataFrame:
    totals = metrics.agg(
        F.count(F.lit(1)).alias("total_sites"), F.sum("subject_count").alias("total_patients"), F.avg(_dqi()).alias("avg_dqi")
    )
    queries = open_queries.agg(F.count(F.lit(1)).alias("total_open_queries"))
    return attach_scalars(totals, queries).withColumn("timeline_risk_percent", timeline_risk(F.col("avg_dqi")))


def site_fact_sheet(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """Missing-page and visit totals of every site; ``pages(site, days)``, ``visits(site, days)``."""
    p = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("page_rows"), F.sum("days").alias("missing_days"), F.avg("days").alias("mean_missing_days")
    )
    v = visits.groupBy("site").agg(F.count(F.lit(1)).alias("visit_rows"), F.sum("days").alias("days_outstanding"))
    return p.join(v, "site", "full_outer")
