"""Ranks, running totals and exact quantiles that never pull a table into one task.

A window without a partition key, or with a key that holds a third of the rows,
sorts that share in a single task. The functions here range-partition on the full
ordering key instead (which ends in a unique id, so equal values still split), number
the rows inside each range, and add one offset per range: a table of as many rows as
there are partitions. Quantiles need no order of all rows: a sketch with a proven rank
error brackets each, and only the values inside the brackets are ordered. Both have one
path for inputs of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

#: Rank error of the bracketing sketch as a share of the rows is one over this.
ACCURACY = 10_000
_ROW_BITS = 33


def _offsets(totals: DataFrame, weights: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over range partitions; one row per partition."""
    rows = totals.collect()
    running = {w: 0 for w in weights}
    out = []
    for row in sorted(rows, key=lambda r: r["_part"]):
        out.append((row["_part"], *[running[w] for w in weights]))
        for w in weights:
            running[w] += row[w]
    fields = ", ".join(["_part long"] + [f"_off_{w} long" for w in weights])
    return totals.sparkSession.createDataFrame(out, fields)


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "rank",
    total: str | None = "total",
) -> DataFrame:
    """Add the 1-based ordinal position (and group size) of every row.

    ``order`` must end in a unique key. ``df`` should be staged: it is read more
    than once.
    """
    within = list(within)
    keys = [F.col(c).asc_nulls_first() for c in within] + list(order)
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()),
        "position",
    )
    ranged = ranged.withColumn("_part", F.shiftright("_mid", _ROW_BITS)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    offsets = _offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), ["n"])
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_off_n") + F.col("_row"))
    if within:
        groups = placed.groupBy(*within).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_size"))
        groups = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], "_start", "_size")
        cond = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)]
        placed = placed.join(groups, cond, "left")
    else:
        size = placed.count()
        placed = placed.withColumn("_start", F.lit(0)).withColumn("_size", F.lit(size).cast("long"))
    placed = placed.withColumn(name, (F.col("_pos") - F.col("_start") + 1).cast("long"))
    keep = [*df.columns, name]
    if total:
        placed = placed.withColumn(total, F.col("_size"))
        keep.append(total)
    return placed.select(*keep)


def with_running_totals(
    df: DataFrame,
    order: Sequence[Column],
    weights: Sequence[str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<w>`` (inclusive running sum) and ``all_<w>`` (group sum) for integer weights.

    Callers aggregate to distinct ordering keys first, so a heavily repeated value
    is one row here.
    """
    within = list(within)
    keys = [F.col(c).asc_nulls_first() for c in within] + list(order)
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()),
        "running",
    ).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    offsets = _offsets(ranged.groupBy("_part").agg(*[F.sum(w).alias(w) for w in weights]), weights)
    local = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(offsets), "_part")
    for name in weights:
        placed = placed.withColumn(f"_abs_{name}", F.sum(name).over(local) + F.col(f"_off_{name}"))
    placed = stage(placed, "running")
    if within:
        groups = placed.groupBy(*within).agg(
            *[F.min(F.col(f"_abs_{n}") - F.col(n)).alias(f"_base_{n}") for n in weights],
            *[F.sum(n).alias(f"all_{n}") for n in weights],
        )
        cond = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)]
        groups = groups.select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)],
            *[f"_base_{n}" for n in weights],
            *[f"all_{n}" for n in weights],
        )
        placed = placed.join(groups, cond, "left")
    else:
        sums = placed.agg(*[F.sum(n).alias(n) for n in weights]).first()
        for n in weights:
            placed = placed.withColumn(f"_base_{n}", F.lit(0)).withColumn(f"all_{n}", F.lit(sums[n]).cast("long"))
    for n in weights:
        placed = placed.withColumn(f"cum_{n}", F.col(f"_abs_{n}") - F.col(f"_base_{n}"))
    return placed.select(*df.columns, *[c for n in weights for c in (f"cum_{n}", f"all_{n}")])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``.

    A sketch of each group brackets every wanted rank within ``2 / ACCURACY`` of the rows on
    either side. Below a bracket only the count and largest value matter, above it only
    the smallest value; the values inside, a ``4 / ACCURACY`` share at most, are ordered.
    ``df`` should be staged: it is read twice.
    """
    by = list(by)
    groups = [f"_g{i}" for i in range(len(by))]
    present = df.where(F.col(value).isNotNull()).select(
        *[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(value).cast("double").alias("_v")
    )
    reach = 2.0 / ACCURACY
    ends = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-reach, reach)]
    bounds = present.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_ends")
    )
    renamed = bounds.select(*[F.col(g).alias(f"_b{g}") for g in groups], "_n", "_ends")
    match = [F.col(g).eqNullSafe(F.col(f"_b{g}")) for g in groups]
    paired = present.join(renamed, match) if groups else present.crossJoin(F.broadcast(renamed))  # one row
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.col("_ends")[2 * i].alias("lo"), F.col("_ends")[2 * i + 1].alias("hi"))
            for i, p in enumerate(probs.values())
        ]
    )
    each = paired.select(*groups, "_v", "_n", F.inline(wanted))
    side = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    each = each.withColumn("_side", side).withColumn("_in", F.when(F.col("_side") == 0, F.col("_v")))
    tallied = each.groupBy(*groups, "i", "p", "_n", "_side", "_in").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    # below: only its last place is named; above: only its first
    rows = tallied.select(
        *groups, "i", "p", "_n", "_side", F.when(F.col("_side") < 0, F.col("_high")).otherwise(F.col("_low")).alias("_v"),
        F.when(F.col("_side") > 0, F.lit(1)).otherwise(F.col("_c")).alias("_c"),
    )
    upto = Window.partitionBy(*groups, "i").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("_c").over(upto))
    rows = rows.withColumn("_first", F.when(F.col("_side") < 0, F.col("_end") - 1).otherwise(F.col("_end") - F.col("_c")))
    target = (F.col("_n") - 1) * F.col("p")
    low = F.floor(target)
    high = F.least(low + 1, F.col("_n") - 1)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_first") <= position) & (position < F.col("_end")), F.col("_v")))

    found = rows.groupBy(*groups, "i").agg(at(low).alias("_lo"), at(high).alias("_hi"), F.max(target - low).alias("_f"))
    exact = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")
    named = [F.max(F.when(F.col("i") == i, exact)).alias(name) for i, name in enumerate(probs)]
    return found.groupBy(*groups).agg(*named).select(*[F.col(g).alias(c) for c, g in zip(by, groups)], *probs)


def drawn(hash_: Column, wanted: int, total: Column | int) -> Column:
    """Whether a row may be among the ``wanted`` smallest of ``total`` evenly spread hashes.

    About twice as many rows as wanted pass, whatever the total, so that a sort or a limit
    after it gets a bounded input, and far more than chance could leave short.
    """
    total = F.lit(total) if isinstance(total, int) else total
    return F.shiftrightunsigned(hash_, 1) / F.lit(float(1 << 63)) <= F.lit(2.0 * wanted + 64.0) / F.greatest(total, F.lit(1))


def top_per_group(df: DataFrame, within: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark prunes to ``k`` rows per map task before the shuffle."""
    w = Window.partitionBy(*[F.col(c) for c in within]).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)
