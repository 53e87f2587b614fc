"""Cleaning, projection and filter operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming

EMPTY_SHARE = 0.95

# Feature defaults used when a site has no rows in a source.
FEATURE_DEFAULTS: dict[str, float] = {
    "missing_visits_pct": 0.0,
    "missing_pages_pct": 0.0,
    "open_issues_per_subject": 0.0,
    "safety_pending_pct": 0.0,
    "meddra_coding_rate": 0.99,
    "whodd_coding_rate": 0.99,
    "days_outstanding_avg": 0.0,
    "days_pages_missing_avg": 0.0,
}


def _null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column in one pass; a row as wide as the schema."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def drop_near_empty_columns(df: DataFrame, share: float = EMPTY_SHARE) -> DataFrame:
    rows, nulls = _null_counts(df)
    if rows == 0:
        return df
    return df.select(*[c for c in df.columns if nulls[c] / rows < share])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Rows that are null throughout, then columns that are."""
    kept = df.dropna("all")
    rows, nulls = _null_counts(kept)
    return kept.select(*[c for c in kept.columns if rows == 0 or nulls[c] < rows])


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "date" in c.lower() or "timestamp" in c.lower()]


def coerce_dates(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Named date columns become timestamps; text that is not a date becomes null."""
    for c in columns if columns is not None else date_columns(df):
        if c in df.columns:
            df = df.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
    return df


def as_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def preprocess(df: DataFrame) -> DataFrame:
    """Standard names, unique names, no near-empty columns, no duplicate rows, typed dates."""
    return (
        df.transform(naming.standardise_columns)
        .transform(naming.first_of_each_name)
        .transform(drop_near_empty_columns)
        .dropDuplicates()
        .transform(coerce_dates)
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: missing count and percent, type; plus table totals on every row."""
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"m{i}").alias("missing"))
            for i, c in enumerate(df.columns)
        ]
    )
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    wide = df.agg(*aggs)
    # two one-row aggregates side by side: an equi-join on a constant key
    both = wide.withColumn("_k", F.lit(1)).join(distinct.withColumn("_k", F.lit(1)), "_k")
    return both.select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "duplicate_rows", F.explode(entries).alias("e")).select(
        F.col("e.column").alias("column"),
        F.col("e.type").alias("type"),
        F.col("e.missing").alias("missing"),
        F.round(F.col("e.missing") * 100.0 / F.col("row_count"), 2).alias("percent"),
        "row_count",
        "column_count",
        "duplicate_rows",
    )


def prefixed_id(col: Column, prefix: str) -> Column:
    """Add ``prefix`` unless the id already starts with it, ignoring case."""
    bare = F.trim(col.cast("string"))
    return F.when(F.lower(bare).startswith(prefix.lower()), bare).otherwise(F.concat(F.lit(prefix + " "), bare))


def match_ids(wanted: DataFrame, known: DataFrame, key: str, prefix: str = "Site") -> DataFrame:
    """Resolve loosely written ids: exact first, then ignoring case and prefix.

    Both sides reduce to one normal form, so this is an equi-join, not a comparison
    of every pair.
    """
    strip = rf"(?i)^{prefix}\s+"
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c.cast("string")), strip, ""))
    left = wanted.select(F.col(key).alias("requested"), norm(F.col(key)).alias("_n"))
    right = known.select(F.col(key).alias("matched"), norm(F.col(key)).alias("_n"))
    priority = F.struct((F.col("requested") != F.col("matched")).alias("p"), F.col("matched").alias("m"))
    return left.join(right, "_n").groupBy("requested").agg(F.min(priority).alias("b")).select("requested", F.col("b.m").alias("matched"))


def status_contains(col: Column, word: str) -> Column:
    """Case-insensitive substring test; a null status is false."""
    return F.coalesce(F.lower(col).contains(word.lower()), F.lit(False))


def coded(col: Column, match: str = "word") -> Column:
    """``word`` (default) accepts 'coded term' only; ``substring`` also accepts 'uncoded'."""
    if match == "substring":
        return status_contains(col, "coded")
    return F.coalesce(F.lower(col).rlike(r"\bcoded\b"), F.lit(False))


def fill_defaults(df: DataFrame, defaults: dict[str, float] = FEATURE_DEFAULTS) -> DataFrame:
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def membership_filter(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return df.where(F.col(column) >= minimum)
