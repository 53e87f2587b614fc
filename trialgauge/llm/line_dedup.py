"""Boilerplate lines by their spread over sites, with HyperLogLog sketches.

A line is boilerplate if it stands on at least ``min_sites`` different sites. Each line has a
sketch of its sites; sketches of parts of the data merge by aggregation. A sketch far from
the threshold decides by itself; lines whose estimate lies within its error of the threshold
get an exact count. A boilerplate line then leaves every document but the first that has it,
so that a text copied to many sites is not lost altogether.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .rows import wrapped

@dataclass(frozen=True)
class Spread:
    """``band``: estimates within this share of ``min_sites``, and at least one site, are counted
    exactly. A sketch of 2**``lg_k`` cells has a standard error of about 1.04 / sqrt(2**lg_k)
    (1.6 % at 12), so the default band is twelve of them. Every line that is not blank counts by
    default; ``min_chars`` is the least length, without the blanks around it, of a line that may be boilerplate."""

    min_sites: int = 10
    min_chars: int = 1
    lg_k: int = 12
    band: float = 0.2


#: Sketches of a line are built in so many parts before they merge.
PARTS = 8


def _lines(docs: DataFrame, min_chars: int, *carry: Column | str) -> DataFrame:
    """Place and 128-bit hash of the lines that may be boilerplate, beside the carried columns."""
    line = F.trim(F.col("_line"))
    rows = docs.where(F.col("text").isNotNull()).select(*carry, F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
    return rows.where(F.length(line) >= min_chars).select(
        *[c for c in rows.columns if c != "_line"], F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")
    )


def boilerplate(rows: DataFrame, how: Spread = Spread()) -> DataFrame:
    """From ``_id, site, text``, ``a, b, first``: hash of each line on ``min_sites`` sites or more, and the smallest id
    that has it. Rows without a site count for no spread but may be the first."""
    if how.min_sites < 2:
        raise ValueError("a line on one site is no boilerplate")
    lines = _lines(rows, how.min_chars, F.xxhash64(F.col("site").cast("string")).alias("_site"), F.col("site").isNull().alias("_none"), "_id")
    spread = lines.groupBy("a", "b", "_site", "_none").agg(F.min("_id").alias("low"))
    spread = stage(spread, "spread")
    # sketches only for lines that two sites share: their smallest and largest site differ
    known = F.when(~F.col("_none"), F.col("_site"))
    ends = spread.groupBy("a", "b").agg(F.min(known).alias("one"), F.max(known).alias("other"), F.min("low").alias("first"))
    shared = stage(ends.where("one != other").select("a", "b", "first"), "shared")
    pairs = spread.where("not _none").join(shared, ["a", "b"]).select("a", "b", "first", "_site")
    part = F.pmod("_site", F.lit(PARTS)).alias("_part")
    sketched = pairs.groupBy("a", "b", "first", part).agg(F.hll_sketch_agg("_site", how.lg_k).alias("sketch"))
    merged = sketched.groupBy("a", "b", "first").agg(F.hll_union_agg("sketch").alias("sketch"))
    estimate = stage(merged.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")), "estimate")
    margin = max(1.0, how.band * how.min_sites)
    sure = estimate.where(F.col("sites") > how.min_sites + margin).select("a", "b", "first")
    close = estimate.where(F.abs(F.col("sites") - how.min_sites) <= margin).select("a", "b")
    exact = pairs.join(close, ["a", "b"], "left_semi").groupBy("a", "b", "first").agg(F.count(F.lit(1)).alias("sites"))
    return sure.union(exact.where(F.col("sites") >= how.min_sites).select("a", "b", "first"))


def drop_boilerplate(docs: DataFrame, site: str = "source", how: Spread = Spread()) -> DataFrame:
    """All columns of every row, the text without its boilerplate lines, and ``n_lines``, ``n_removed``.

    Lines are what ``\\n`` separates; they are compared without blanks around them, whole. A null text
    stays null and has no lines, an empty one has an empty line. Null ids come last, so such a
    row keeps a boilerplate line only where no row with an id has it; rows with one id are the
    same document. Input columns named like the two counts are replaced. An empty table gives an
    empty result.
    """
    carry = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = wrapped(docs)
    bad = stage(boilerplate(rows.select("_id", F.col("_row")[site].alias("site"), "text"), how), "boilerplate")
    places = _lines(rows, how.min_chars, "_id", "_hash").join(bad, ["a", "b"])
    gone = places.where(F.col("_id") != F.col("first")).groupBy("_id", "_hash").agg(F.collect_set("_at").alias("_gone"))
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    )
    joined = rows.join(gone, ["_id", "_hash"], "left")
    return joined.select(
        *[left.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in carry],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
