"""Value index, approximate entity lookup, vector search, table profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans.ordering import top_per_group
from ..plans.staging import stage
from . import set_join

JACCARD_FLOOR = 0.3
MIN_LENGTH, MAX_LENGTH = 2, 199
QUERY_BLOCK = 2048


def value_index(tables: dict[str, DataFrame], per_column: int | None = None) -> DataFrame:
    """``value, table_name, column_name`` of distinct text values.

    Columns whose name starts with an underscore are skipped. ``per_column`` keeps the
    first values in order; the default keeps all.
    """
    parts = []
    for name, df in tables.items():
        columns = [c for c, t in df.dtypes if t == "string" and not c.startswith("_")]
        if name.startswith("_") or not columns:
            continue
        rows = df.select(*columns).unpivot([], columns, "column_name", "value")
        kept = rows.where(F.col("value").isNotNull() & (F.length("value") >= MIN_LENGTH) & (F.length("value") <= MAX_LENGTH))
        parts.append(kept.distinct().select("value", F.lit(name).alias("table_name"), "column_name"))
    whole = reduce(DataFrame.unionByName, parts)
    if per_column is None:
        return whole
    return top_per_group(whole, ["table_name", "column_name"], [F.asc("value")], per_column).drop("rank")


#: Shingles times permutations held at a time while signatures are made.
_SIGNATURE_CELLS = 1 << 22


def _signatures(digests: pd.Series) -> pd.Series:
    """Smallest permuted digest per permutation, for all values of a batch in array steps."""
    a, b = (np.array(x, np.int64) for x in tx.coefficients())
    out: list[np.ndarray | None] = []
    for h in digests:
        if h is None or not len(h):
            out.append(None if h is None else np.full(len(a), tx.PRIME, np.int64))
            continue
        best = np.full(len(a), tx.PRIME, np.int64)
        step = max(1, _SIGNATURE_CELLS // len(a))
        for at in range(0, len(h), step):
            part = np.asarray(h[at : at + step], np.int64)[:, None]
            best = np.minimum(best, ((part * a + b) % tx.PRIME).min(axis=0))
        out.append(best)
    return pd.Series(out)


def with_signature(values: DataFrame, column: str = "value") -> DataFrame:
    """Add ``grams`` and ``signature``; digests are computed once, signatures in Arrow batches."""
    signature = F.pandas_udf(_signatures, "array<bigint>")
    return (
        values.withColumn("grams", tx.shingles(column))
        .withColumn("digests", tx.digests("grams"))
        .withColumn("signature", signature("digests"))
        .drop("digests")
    )


def banded(signed: DataFrame, *keep: str) -> DataFrame:
    """One row per value and band: ``band, bucket``."""
    return signed.select(*keep, F.posexplode_outer(tx.bands("signature")).alias("band", "bucket"))


def lsh_candidates(index: DataFrame, keywords: DataFrame, floor: float = JACCARD_FLOOR) -> DataFrame:
    """``keyword, value, jaccard`` for pairs sharing a band and overlapping enough.

    Distinct values are hashed once however many columns hold them. A bucket pairs only
    keywords with values, never values with each other.
    """
    values = stage(with_signature(index.select("value").distinct()), "values")
    asked = stage(with_signature(keywords.select("keyword").distinct(), "keyword"), "keywords")
    pairs = (
        banded(asked, "keyword").join(banded(values, "value"), ["band", "bucket"]).select("keyword", "value").distinct()
    )
    scored = pairs.join(asked.select("keyword", F.col("grams").alias("kg")), "keyword").join(
        values.select("value", "grams"), "value"
    )
    return scored.select("keyword", "value", tx.jaccard(F.col("kg"), F.col("grams")).alias("jaccard")).where(F.col("jaccard") >= floor)


def lsh_search(index: DataFrame, keywords: DataFrame, top_k: int = 10) -> DataFrame:
    return top_per_group(lsh_candidates(index, keywords), ["keyword"], [F.desc("jaccard"), F.asc("value")], top_k)


def retrieve_entities(index: DataFrame, keywords: DataFrame, top_k: int = 10) -> DataFrame:
    """Best entities per keyword by mean of Jaccard and edit similarity; keywords of one
    character are skipped. Twice ``top_k`` index entries are rated per keyword."""
    asked = keywords.where(F.length("keyword") >= 2)
    entries = lsh_candidates(index, asked).join(index, "value")
    place = [F.asc(c) for c in ("value", "table_name", "column_name")]
    first = top_per_group(entries, ["keyword"], [F.desc("jaccard"), *place], top_k * 2).drop("rank")
    rated = first.withColumn("similarity", (F.col("jaccard") + tx.edit_similarity(F.col("keyword"), F.col("value"))) / 2)
    return top_per_group(rated, ["keyword"], [F.desc("similarity"), *place], top_k).select(
        "keyword", "value", "table_name", "column_name", "similarity", "rank"
    )


#: Bytes of the vectors of one side that meet in a task.
PART_BYTES = 16 << 20


def parts_of(queries: int, base: int, part: int, block: int, tasks: int) -> tuple[int, int]:
    """Into how many parts of at most ``part`` rows queries and base are cut: about ``tasks`` pairs of parts with few copies, parts not under ``block`` rows."""
    share = math.sqrt(tasks * max(base, 1) / max(queries, 1))
    fit = lambda n, wanted: max(1, -(-n // part), min(-(-n // block), wanted))
    right = fit(base, math.ceil(share))
    return fit(queries, math.ceil(tasks / right)), right


def vector_top_k(base: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k: ``query_id, id, similarity, rank``.

    ``base(id, vec)``, ``queries(query_id, vec)``. Both sides are cut into parts of at most ``PART_BYTES``; each pair of
    parts meets in one task, which multiplies ``query_block`` queries at a time and emits the best k per query, so no task holds either side
    whole and a vector is copied once per part of the other side. The work is the product of both sizes: for many queries ``bucketed_top_k`` is the
    operator to use.
    """
    schema = "query_id long, id long, similarity double"

    def best(rows: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k entries of every row by falling similarity and rising id."""
        order = np.lexsort((ids, -sim, rows))
        rows, ids, sim = rows[order], ids[order], sim[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
        keep = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k
        return rows[keep], ids[keep], sim[keep]

    def product(q: np.ndarray, q_norm: np.ndarray, ids: np.ndarray, x: np.ndarray, x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm = q_norm[:, None] * x_norm[None, :]
        sim = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
        if k < len(ids):
            least = np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
            rows, cols = np.nonzero((-sim <= least) | np.isnan(least))
        else:
            rows, cols = (a.ravel() for a in np.indices(sim.shape))
        return best(rows, ids[cols], sim[rows, cols])

    def matrix(series: pd.Series) -> np.ndarray:
        return np.stack(series.to_numpy()).astype(float)

    first = base.select(F.size("vec").alias("n")).first()
    part = max(query_block, PART_BYTES // (8 * max(1, (first and first["n"]) or 1)))
    left, right = parts_of(queries.count(), base.count(), part, query_block, 4 * base.sparkSession.sparkContext.defaultParallelism)
    both = lambda df, key, own, other, size, count: df.withColumn(
        own, F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
    ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    q_side = both(queries.select("query_id", "vec"), "query_id", "qb", "bb", left, right)
    b_side = both(base.select("id", "vec"), "id", "bb", "qb", right, left)

    def block(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        q_ids, ids, q_all, x_all = q["query_id"].to_numpy(), b["id"].to_numpy(), matrix(q["vec"]), matrix(b["vec"])
        q_norm, x_norm = np.linalg.norm(q_all, axis=1), np.linalg.norm(x_all, axis=1)
        cuts = lambda n, size: [slice(i, i + size) for i in range(0, n, size)]
        out = []
        for c in cuts(len(q_ids), query_block):
            met = [product(q_all[c], q_norm[c], ids[d], x_all[d], x_norm[d]) for d in cuts(len(ids), QUERY_BLOCK)]
            rows, found_ids, sim = best(*(np.concatenate(a) for a in zip(*met, strict=True)))
            out.append(pd.DataFrame({"query_id": q_ids[c][rows], "id": found_ids, "similarity": sim}))
        return pd.concat(out)

    found = q_side.groupBy("qb", "bb").cogroup(b_side.groupBy("qb", "bb")).applyInPandas(block, schema)
    return top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


#: Vectors that a bucket holds on average.
BUCKET_ROWS = 4


def planes_for(rows: int) -> int:
    """Directions per table, so that buckets stay of one size however many vectors there are."""
    return max(1, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))


def bucketed_top_k(
    base: DataFrame, queries: DataFrame, k: int = 5, planes: int | None = None, tables: int = 24, probes: int = 32, rated: int | None = None, seed: int = 42
) -> DataFrame:
    """Cosine top-k by random directions: ``query_id, id, similarity, rank, candidates``.

    In each of ``tables`` tables a vector's bucket is the signs of its products with ``planes`` random
    directions, by default as many as keep buckets of one size, and vectors are filed under it once. A query
    looks into its own bucket and those that differ in the directions it is closest to the border of, ``probes``
    in all. All vectors met are compared in full, or the ``rated`` best of a query by the tables they
    were met in, nearer buckets counting more. Buckets met per query do not grow with
    ``base``. Approximate: the registered query measures the recall against the exact scan; vectors
    without near neighbours need many probes, close ones few.
    """
    first = base.select("vec").first()
    dims = len(first["vec"]) if first else 0
    planes = planes or planes_for(base.count())
    directions = np.random.default_rng(seed).normal(size=(tables, planes, dims))
    power = 1 << np.arange(planes, dtype=np.int64)
    shift = np.arange(tables, dtype=np.int64)[None, :] << planes
    # sets of directions to flip, those with the fewest first; a query orders them by what they cost it
    some = min(planes, 6)
    flips = np.array([[bool(m >> i & 1) for i in range(some)] for m in range(1 << some)])

    def products(pdf: pd.DataFrame) -> np.ndarray:
        return np.einsum("tpd,nd->ntp", directions, np.stack(pdf["vec"].to_numpy()).astype(float), optimize=True)

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["id"]].assign(bucket=list(((products(pdf) > 0) @ power + shift)))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = products(pdf)
            close = np.argsort(np.abs(x), axis=2, kind="stable")[:, :, :some]
            cost = np.take_along_axis(x, close, 2) ** 2 @ flips.T
            best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            mask = (flips[best] * power[close][:, :, None, :]).sum(3)
            own = ((x > 0) @ power)[:, :, None] ^ mask
            yield pdf[["query_id"]].assign(bucket=list((own + shift[:, :, None]).reshape(len(pdf), -1)), turn=[np.tile(np.arange(best.shape[2]), tables)] * len(pdf))

    held = stage(base.select("id", "vec").mapInPandas(filed, "id long, bucket array<long>").select("id", F.explode("bucket").alias("bucket")), "filed")
    asked = queries.select("query_id", "vec").mapInPandas(probed, "query_id long, bucket array<long>, turn array<int>")
    asked = asked.select("query_id", F.inline(F.arrays_zip("bucket", "turn")))
    met = asked.join(held, "bucket").groupBy("query_id", "id").agg(F.sum(1 / (1 + F.col("turn"))).alias("weight"))
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("candidates")
    met = met.select("query_id", "id", "weight", count)
    best = met if rated is None else top_per_group(met, ["query_id"], [F.desc("weight"), F.asc("id")], rated)
    scored = _similar_pairs(best.select("query_id", "id", "candidates"), base, queries)
    return top_per_group(scored, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def _similar_pairs(pairs: DataFrame, base: DataFrame, queries: DataFrame, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, similarity, candidates`` of ``pairs(query_id, id, candidates)``.

    A pair moves as three numbers to the block of its two ends. Vectors move once per block of the other side,
    not once per pair.
    """
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left, right = (max(1, -(-df.count() // block_rows)) for df in (queries, base))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.lit(True).alias("asks"), F.col("query_id").alias("key"), "vec", of("query_id", left).alias("qb"), every(right).alias("bb"))
    known = base.select(F.lit(False).alias("asks"), F.col("id").alias("key"), "vec", every(left).alias("qb"), of("id", right).alias("bb"))
    placed = pairs.select("query_id", "id", "candidates", of("query_id", left).alias("qb"), of("id", right).alias("bb"))

    def rated(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = p[["query_id", "id", "candidates"]]
        if p.empty or v.empty:
            return out.iloc[:0].assign(similarity=np.zeros(0))

        def side(asks: bool, wanted: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = v[v["asks"] == asks].sort_values("key")
            x = np.stack(own["vec"].to_numpy()).astype(float)
            return x, np.linalg.norm(x, axis=1), np.searchsorted(own["key"].to_numpy(), wanted.to_numpy())

        (q, qn, r), (b, bn, c) = side(True, p["query_id"]), side(False, p["id"])
        similarity = np.zeros(len(p))
        for at in range(0, len(p), 1 << 16):
            i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
            norm = qn[i] * bn[j]
            similarity[at : at + (1 << 16)] = np.divide(np.einsum("nd,nd->n", q[i], b[j]), norm, out=np.zeros(len(i)), where=norm > 0)
        return out.assign(similarity=similarity)

    cells = placed.groupBy("qb", "bb").cogroup(asked.unionByName(known).groupBy("qb", "bb"))
    return cells.applyInPandas(rated, "query_id long, id long, candidates long, similarity double")


def similar_values(values: DataFrame, keywords: DataFrame, percent: int) -> DataFrame:
    """``keyword, value, jaccard``: all pairs whose shingles are similar enough; exact, where ``lsh_candidates`` can miss pairs."""
    left = keywords.select(F.col("keyword").alias("id"), tx.shingles("keyword").alias("items")).distinct()
    right = values.select(F.col("value").alias("id"), tx.shingles("value").alias("items")).distinct()
    found = set_join.similar_sets(left, right, percent)
    return found.select(F.col("u").alias("keyword"), F.col("v").alias("value"), "jaccard")


def edit_join(values: DataFrame, keywords: DataFrame, edits: int) -> DataFrame:
    """``keyword, value, distance``: all pairs at most ``edits`` case-insensitive edits apart; exact.

    A value is cut into ``edits + 1`` pieces. Edits can touch all but one of them, and the untouched one
    stands in the keyword at most ``edits`` places off. So values are listed under their length and
    pieces, keywords under what could be such a piece, and only pairs that meet are measured.
    """
    text = lambda c: F.lower(F.col(c))
    pieces = edits + 1
    start = lambda i: F.floor(i * F.col("size") / pieces).cast("int")
    i = F.col("i")
    held = values.select("value").where(F.col("value").isNotNull()).distinct().withColumn("size", F.length("value"))
    held = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    held = held.select("value", "size", "i", F.substring(text("value"), start(i) + 1, start(i + 1) - start(i)).alias("piece"))
    asked = keywords.select("keyword").where(F.col("keyword").isNotNull()).distinct().withColumn("own", F.length("keyword"))
    asked = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - edits), F.col("own") + edits)))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits)))).withColumn("n", start(i + 1) - start(i))
    low, high = F.greatest(F.lit(0), start(i) - edits), F.least(start(i) + edits, F.col("own") - F.col("n"))
    asked = asked.where(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    asked = asked.select("keyword", "size", "i", F.substring(text("keyword"), F.col("at") + 1, F.col("n")).alias("piece")).distinct()
    met = asked.join(held, ["size", "i", "piece"]).select("keyword", "value").distinct()
    rated = met.withColumn("distance", F.levenshtein(text("keyword"), text("value"), edits))
    return rated.where(F.col("distance") >= 0)


def _columns_long(df: DataFrame) -> DataFrame:
    """``column, value`` of every cell that is not null, as text; one scan."""
    names = [f"c{i}" for i in range(len(df.columns))]
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(n).alias("value")) for c, n in zip(df.columns, names)])
    return text.select(F.inline(cells)).where(F.col("value").isNotNull())


def smallest_values(df: DataFrame, k: int) -> DataFrame:
    """``column, samples``: the k smallest distinct values of every column, as text."""
    first = top_per_group(_columns_long(df).distinct(), ["column"], [F.asc("value")], k)
    return first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def table_profile(df: DataFrame, name: str, descriptions: DataFrame | None = None) -> DataFrame:
    """Columns with type, nulls, row count and the three smallest values."""
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), (F.col(f"n{i}") > 0).alias("has_nulls"),
                F.col(f"n{i}").alias("null_count"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    out = counts.select(F.lit(name).alias("table_name"), "row_count", F.inline_outer(rows))
    out = out.join(smallest_values(df, 3).withColumnRenamed("column", "column_name"), "column_name", "left")
    if descriptions is not None:
        out = out.join(descriptions, ["table_name", "column_name"], "left")
    return out


def result_statistics(df: DataFrame) -> DataFrame:
    """Per column: numeric range and mean when every value is a number, else distinct
    count and five samples, the smallest; nulls skipped. Two scans for all columns."""
    number = F.col("value").try_cast("double")
    rows = _columns_long(df).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(number.isNotNull()) == F.count(F.lit(1))).alias("numeric"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("avg"),
        F.countDistinct("value").alias("unique_count"),
    )
    rows = rows.join(smallest_values(df, 5), "column")
    only = lambda cond, c: F.when(cond, F.col(c)).alias(c)
    num = F.col("numeric")
    return rows.select(
        "column", "n", F.when(num, "numeric").otherwise("categorical").alias("type"),
        only(num, "min"), only(num, "max"), only(num, "avg"), only(~num, "unique_count"), only(~num, "samples"),
    )
