"""Exact similarity join of sets by prefix filtering.

Two sets with a Jaccard similarity of at least p share an item among the first few of each when all
items are in one order, the rarest first. So a set is listed under those items only, and a pair is
met where both are listed. The sizes of the two sets and the places of the common item bound the
overlap that is still possible, which drops most of the pairs met; what is left is decided on the
whole sets. An item that very many sets are listed under is cut into tiles of a bounded number of
sets on either side, so no task holds all of its sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

#: Sets on one side of a tile of a frequent item's list.
TILE = 2000


def _least_overlap(x: Column, y: Column, percent: int) -> Column:
    """The least number of common items of sets of these sizes that are similar enough."""
    return F.ceil(percent * (x + y) / F.lit(100 + percent))


def listed(sets: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """``item, id, size, at, asks, tag``: the items every set of ``sets(id, items, asks, tag)`` is listed under."""
    items = sets.select("id", "asks", "tag", F.size("items").alias("size"), F.explode("items").alias("item"))
    ranked = items.join(counts, "item").groupBy("id", "asks", "tag", "size").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("order"))
    first = F.col("size") - F.ceil(percent * F.col("size") / 100).cast("int") + 1
    return ranked.select("id", "asks", "tag", "size", F.posexplode(F.slice("order", F.lit(1), first)).alias("at", "o")).select(
        F.col("o.item").alias("item"), "id", "size", "at", "asks", "tag"
    )


def candidates(left: DataFrame, right: DataFrame | None, percent: int) -> DataFrame:
    """``u, v``: pairs that may be similar enough. Sides are ``(id, items)``. With one side the pairs are ``u < v``
    among its sets; if it has columns ``asks`` and ``tag``, those of which at least one set asks and the tags differ."""
    every_pair = right is not None or "asks" not in left.columns
    sides = [left] if right is None else [left, right]
    if every_pair:
        sides = [side.withColumns({"asks": F.lit(True), "tag": F.lit(None).cast("long")}) for side in sides]
    whole = sides[0] if right is None else left.select("items").union(right.select("items"))
    counts = whole.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    lists = [stage(listed(side, counts, percent), "listed") for side in sides]
    l_list, r_list = lists[0].where("asks"), lists[-1]
    # items that both sides list, and how many tiles their lists are cut into
    tiles = lambda c: F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(c)
    both = l_list.groupBy("item").agg(tiles("tl")).join(r_list.groupBy("item").agg(tiles("tr"), F.count(F.lit(1)).alias("n")), "item")
    both = (both.where("n > 1") if right is None else both).select("item", "tl", "tr")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    l_tiles = l_list.join(both, "item").select("item", own("tl").alias("i"), every("tr").alias("j"), *[F.col(c).alias(f"{c}_u") for c in ("id", "size", "at", "tag")])
    r_tiles = r_list.join(both, "item").select("item", own("tr").alias("j"), every("tl").alias("i"), *[F.col(c).alias(f"{c}_v") for c in ("id", "size", "at", "tag", "asks")])
    met = l_tiles.join(r_tiles, ["item", "i", "j"])
    u, v = F.col("id_u"), F.col("id_v")
    if not every_pair:
        met = met.where(F.col("tag_u") != F.col("tag_v"))
    if right is None:
        # a pair of which both sets ask is met from either side
        met = met.where((u < v) | ((u > v) & ~F.col("asks_v")))
        u, v = F.least(u, v), F.greatest(u, v)
    x, y = F.col("size_u"), F.col("size_v")
    near = 100 * F.least(x, y) >= percent * F.greatest(x, y)
    reach = 1 + F.least(x - F.col("at_u") - 1, y - F.col("at_v") - 1)
    able = met.where(near & (reach >= _least_overlap(x, y, percent)))
    return able.select(u.alias("u"), v.alias("v")).distinct()


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """``u, v, shared, jaccard``: the pairs whose whole sets are similar enough."""
    both = pairs.join(left.select(F.col("id").alias("u"), F.col("items").alias("iu")), "u")
    both = both.join(right.select(F.col("id").alias("v"), F.col("items").alias("iv")), "v")
    union = F.size("iu") + F.size("iv") - F.col("shared")
    shared = both.withColumn("shared", F.size(F.array_intersect("iu", "iv")))
    return shared.where(100 * F.col("shared") >= percent * union).select("u", "v", "shared", (F.col("shared") / union).alias("jaccard"))


def similar_sets(left: DataFrame, right: DataFrame | None = None, percent: int = 80) -> DataFrame:
    """All pairs with a Jaccard similarity of ``percent`` hundredths or more: ``u, v, shared, jaccard``.

    ``left(id, items)`` and ``right(id, items)`` hold one set per id; without ``right`` the pairs are ``u < v``
    among the sets of ``left``. Null and empty sets have no pair, repeated items of a set count once.
    """
    if not 0 < percent <= 100:
        raise ValueError("a similarity in hundredths lies above 0 and up to 100")
    clean = lambda df: stage(
        df.select("id", F.array_distinct(F.array_compact("items")).alias("items")).where(F.size("items") > 0), "sets"
    )
    one = clean(left)
    other = None if right is None else clean(right)
    pairs = stage(candidates(one, other, percent), "pairs")
    return verified(pairs, one, one if other is None else other, percent)
