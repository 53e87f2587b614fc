"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an
offset and a skip from two hashes of its name. Shards take turns; at a turn a shard claims
its next free slot. A row's key hashes to a slot, which names its shard: placement takes
constant time, shares differ by at most one slot per turn, and a change of shards moves few
keys. The table's size is a parameter, so broadcasting it is bounded at any input size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime well above the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12], 16)


def lookup(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the number of the shard that claimed it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must be one or more different names")
    if slots < 2 or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    # any skip from 1 to slots - 1 visits every slot, as their number is prime
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % slots
        owner[at[shard]] = shard
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 48 bits of the md5 of its text; a null key is the empty text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digest, 16, 10).cast("long") % slots).cast("int")


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: exactly ``slots`` rows."""
    numbers = F.split(F.lit(",".join(map(str, lookup(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.range(1).select(F.posexplode(numbers).alias("slot", "number"))
    return table.select("slot", F.element_at(names, F.col("number").cast("int") + 1).alias("shard"))


def shard(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, carry: Sequence[str] = ()) -> DataFrame:
    """Slot and shard of every row, beside its key and the carried columns.

    Rows with equal keys share a shard, null and empty keys are one key, rows without a shard
    do not exist. Other columns are ignored unless carried; carried columns may not be named
    ``slot`` or ``shard``. An empty table gives an empty result. One broadcast join, no shuffle.
    """
    placed = docs.select(key, *carry, slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(slot_table(docs.sparkSession, shards, slots)), "slot").select(key, *carry, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Write all columns as Parquet, one folder per shard; a shard's rows stay spread over tasks."""
    carry = [c for c in docs.columns if c != key]
    shard(docs, key, shards, slots, carry).drop("slot").write.partitionBy("shard").parquet(path)
