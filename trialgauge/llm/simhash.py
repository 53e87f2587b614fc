"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Two fingerprints are linked if at most four of their 64 bits differ. Then the two 32-bit
segments cannot both differ in three bits or more, so some segment differs in at most two:
both fingerprints lie within one flip of a common value of that segment. Every distinct
fingerprint is entered in a table under the Hamming ball of radius one around each of its
segments; entries that meet are verified on the complete distance.

Equal fingerprints are one entry. An entry of a bounded size is compared inside one array and
yields a link from each fingerprint to the smallest it hangs together with, never all pairs.
A fingerprint in a larger entry is entered under the whole ball of radius two
around its 64 bits instead: fingerprints at most four apart share a point of those balls and
fingerprints that share one are at most four apart, so one link from each to the smallest
of a point loses no component and lists no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.staging import stage
from . import arrays as A
from .rows import LAST_ID, order_id, unwrapped, wrapped

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Entries of up to so many fingerprints are compared pair by pair, inside one array.
ENTRY = 1024
SLICE = 2 << 20


def shingle_hashes(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every row and how many each row has."""
    raw, offs = A.utf8(text)
    starts, lengths, row = A.words(raw, offs, A.NOT_SPACE)
    inside = A.NOT_SPACE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    folded = np.where(inside, A.lower_ascii(raw), np.uint8(0x20))[keep].tobytes()
    moved = np.cumsum(keep) - 1
    begins, ends = moved[starts], moved[starts + lengths - 1] + 1
    # a word at the end of a row has no blank of its own there; no shingle reaches across
    n_words = np.bincount(row, minlength=len(text))
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = (np.cumsum(n_words) - n_words).repeat(count) + np.arange(count.sum()) - (np.cumsum(count) - count).repeat(count)
    last = first + np.minimum(shingle, n_words).repeat(count) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(folded[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)]
    return np.array(hashes, np.uint64), count


def fingerprints(text: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every row: a bit is set if more than half the shingles set it."""
    hashes, count = shingle_hashes(text)
    out = np.zeros(len(text), np.uint64)
    full = np.flatnonzero(count)
    if full.size:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        major = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(major).view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and ``_fp`` (the fingerprint as a signed number) of every row."""
    kept = docs.select(*carry, F.col("text").alias("_text"))
    schema = docs.select(*carry, F.lit(0).cast("long").alias("_fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, text="_text", limit=SLICE):
                fp = pa.array(fingerprints(part.column(part.num_columns - 1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fp], names=[*carry, "_fp"])

    return kept.mapInArrow(run, schema)


def meet(fps: np.ndarray) -> list[tuple[int, int]]:
    """A link from every fingerprint to the smallest it hangs together with inside one entry."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= DISTANCE
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label, len(fps)).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(fps[moved].tolist(), fps[label[moved]].tolist(), strict=True))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by segment and value; hold at most one entry of bounded size."""

    def rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    key, held, crowded = None, np.zeros(0, np.int64), False
    for batch in batches:
        value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else []
        out: list[tuple[int, int]] = []
        for at, to in zip(edges, [*edges[1:], len(value)], strict=True):
            if value[at] != key:
                if len(held) > 1 and not crowded:
                    out += meet(held)
                key, held, crowded = value[at], fp[at:to], False
            else:
                held = np.concatenate([held, fp[at:to]])
            if crowded or len(held) > ENTRY:
                # a link of a fingerprint to itself marks it for the ball around all its bits
                out += [(x, x) for x in held.tolist()]
                crowded, held = True, held[:0]
        yield rows(out)
    yield rows(meet(held) if len(held) > 1 and not crowded else [])


def _flips(bits: range, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame) -> DataFrame:
    """``u, v``: links that join exactly the fingerprints (column ``fp``) reachable in steps of
    at most four bits."""
    balls = []
    for low in (0, 32):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(0xFFFFFFFF))
        flips = F.array(*[F.lit(m) for m in _flips(range(32), 1)])
        # the segment's number keeps the two tables apart
        value = F.col("s").bitwiseXOR(F.col("m")) + F.lit(low << 30)
        balls.append(distinct.select("fp", segment.alias("s"), F.explode(flips).alias("m")).select(value.alias("value"), "fp"))
    table = balls[0].union(balls[1]).repartition("value").sortWithinPartitions("value")
    met = stage(table.mapInArrow(_entries, "u bigint, v bigint").distinct(), "met")
    flips = F.array(*[F.lit(m) for m in _flips(range(64), 2)])
    crowded = met.where(F.col("u") == F.col("v")).select("u")
    points = crowded.select("u", F.explode(flips).alias("m")).select("u", F.col("u").bitwiseXOR(F.col("m")).alias("point"))
    lowest = points.groupBy("point").agg(F.min("u").alias("v"), F.max("u").alias("top")).where("v != top").select("point", "v")
    through = points.join(lowest, "point").where(F.col("u") != F.col("v")).select("u", "v")
    return met.where(F.col("u") != F.col("v")).union(through)


def near_duplicates(rows: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``fp, lowest``: the smallest id reachable over ``link`` from each fingerprint of ``rows(_id, _fp)``."""
    distinct = stage(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("low")), "fps")
    linked = stage(link(distinct), "links")
    nodes = linked.select(F.col("u").alias("id")).union(linked.select(F.col("v").alias("id"))).distinct()
    parts = connected_components(nodes, linked)
    named = distinct.join(parts, distinct["fp"] == parts["id"], "left")
    named = stage(named.select("fp", "low", F.coalesce("component", "fp").alias("part")), "parts")
    lowest = named.groupBy("part").agg(F.min("low").alias("lowest"))
    return named.join(lowest, "part").select("fp", "lowest")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text)``.

    Null, empty and wordless texts have fingerprint zero, linked like any other. A null id
    comes after all others, so a component is null only if all its ids are. Rows with one id
    are rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    table = stage(fingerprint_table(docs, ["doc_id"]), "fingerprints")
    rows = table.select(order_id().alias("_id"), "_fp")
    lowest = near_duplicates(rows)
    joined = table.join(lowest, table["_fp"] == lowest["fp"])
    component = F.when(F.col("lowest") != LAST_ID, F.col("lowest"))
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """All columns of one row of each component: the row with the smallest id, of equal ids
    the one with the smallest hash of its text, of equal rows any one."""
    rows = wrapped(docs)
    table = stage(fingerprint_table(rows, ["_id", "_hash"]), "fingerprints")
    return first_rows(rows, table, near_duplicates(table), docs.columns)


def first_rows(rows: DataFrame, table: DataFrame, lowest: DataFrame, columns: list[str]) -> DataFrame:
    """One of the wrapped ``rows`` of each component, from ``table(_id, _hash, _fp)`` and ``lowest(fp, lowest)``."""
    first = table.join(lowest, (table["_fp"] == lowest["fp"]) & (table["_id"] == lowest["lowest"]))
    stay = first.groupBy("lowest").agg(F.min("_hash").alias("_hash")).withColumnRenamed("lowest", "_id")
    kept = rows.join(stay, ["_id", "_hash"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    return unwrapped(kept.withColumn("_turn", turn).where("_turn = 1"), columns)
