"""Ranked lexical search over an inverted index in blocks of documents.

``build_index`` writes one row per term and block with the postings of the block's documents.
A search needs the weights of the asked terms only, so a first join reads two narrow columns of
the index and a second one the postings of those terms, which meet by block and group of items.
There a hybrid evaluation ranks every item: short lists are summed term at a time into
accumulators, which then count as one list with a bound of its own; that list and the long ones
are evaluated document at a time in windows of documents, where lists whose bounds together
cannot reach the score of the k-th document only answer for documents found elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import stage
from . import arrays as A
from .rows import LAST_ID, order_id

#: Bytes of text in a block of the index; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20
#: Items that are ranked together over a block.
ITEMS = 256
#: A list is short if it holds less than one document of so many.
SHORT = 32
#: Documents in a window of the document-at-a-time part.
WINDOW = 1024
#: Rows of a frequent term's lists that one key of the join holds, about.
ROWS_PER_KEY = 1024
#: Rows in an Arrow batch of the index.
TERMS = 20_000

# fixed values: what a term is
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = "block bigint, term string, df int, places array<int>, counts array<int>, ids array<bigint>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _index_rows(block: int, ids: np.ndarray, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for the block's documents (no term; counts are their lengths) and one per term."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    raw, offs = A.utf8(text)
    folded = A.lower_ascii(raw)
    inside = A.ALNUM[folded]
    starts, lengths = A.runs(inside, offs)
    row = np.searchsorted(offs, starts, "right") - 1
    n = len(ids)
    sizes = np.bincount(row, minlength=n)
    whole = np.array([n])
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([None], pa.string()), pa.array([0], pa.int32()), _lists(np.zeros(0), np.array([0]), pa.int32()),
         _lists(sizes, whole, pa.int32()), _lists(ids, whole, pa.int64())], names=names,
    )
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(folded[inside])).dictionary_encode()
    pairs, counts = np.unique(words.indices.to_numpy().astype(np.int64) * n + row, return_counts=True)
    df = np.bincount(pairs // max(n, 1), minlength=len(words.dictionary))
    first = np.concatenate([[0], np.cumsum(df)])
    for low in range(0, len(df), TERMS):
        high = min(low + TERMS, len(df))
        own = slice(first[low], first[high])
        cut = first[low + 1 : high + 1] - first[low]
        m = high - low
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, block)), words.dictionary.slice(low, m).cast(pa.string()), pa.array(df[low:high], pa.int32()),
             _lists(pairs[own] % n, cut, pa.int32()), _lists(counts[own], cut, pa.int32()), pa.nulls(m, pa.list_(pa.int64()))], names=names,
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows of ``docs(doc_id, text)``: per block, its documents and every term's postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in A.slices(batch, limit=BLOCK_BYTES):
                yield from _index_rows(block, part.column(0).to_numpy(), part.column(1))
                block += 1

    return stage(docs.select(order_id().alias("_id"), "text").mapInArrow(run, INDEX), "lexical")


@dataclass(frozen=True)
class Corpus:
    """What the weights need to know of all documents."""

    documents: int
    terms: int
    blocks: int


def corpus(index: DataFrame) -> Corpus:
    rows = index.where("term is null").select(
        F.expr("size(filter(counts, x -> x > 0))").cast("long").alias("n"), F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("t")
    )
    found = rows.agg(F.sum("n"), F.sum("t"), F.count("*")).first()
    return Corpus(*(int(v or 0) for v in found))


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score; all in 64-bit integers."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _best(scores: np.ndarray, places: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[places], -scores))[:k]


def rank(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, short: int = SHORT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a block with a score above 0, best first, equal ones by id.

    ``lists`` holds, per term, the ascending places of its documents and what each adds.
    """
    n = len(ids)
    summed = np.zeros(n, np.int64)
    long = []
    for places, adds in lists:
        if len(places) * short < n:
            summed[places] += adds
        else:
            long.append((int(adds.max(initial=0)), places, adds))
    found = np.flatnonzero(summed)
    top_places, top = found[:0], summed[:0]
    least = 1
    if len(found) >= k:
        # the accumulators are lower bounds of whole scores
        least = max(least, int(np.partition(summed[found], len(found) - k)[len(found) - k]))
    # the accumulators are one list among the others; the largest bounds come last
    turns = sorted([*long, (int(summed[found].max(initial=0)), found, summed[found])], key=lambda x: x[0])
    reach = np.cumsum([bound for bound, _, _ in turns])
    edges = np.arange(0, n + window, window)
    at = [np.searchsorted(places, edges) for _, places, _ in turns]
    for w in range(len(edges) - 1):
        # lists that even together stay below the k-th score bring no document of their own
        first = int(np.searchsorted(reach, least))
        if first == len(turns):
            break
        score = np.zeros(window, np.int64)
        for j in range(first, len(turns)):
            own = slice(at[j][w], at[j][w + 1])
            score[turns[j][1][own] - edges[w]] += turns[j][2][own]
        places = np.flatnonzero(score)
        score = score[places]
        for j in range(first - 1, -1, -1):
            able = score + reach[j] >= least
            places, score = places[able], score[able]
            if not len(places):
                break
            own = slice(at[j][w], at[j][w + 1])
            known = turns[j][1][own] - edges[w]
            if len(known):
                hit = np.minimum(np.searchsorted(known, places), len(known) - 1)
                score = score + np.where(known[hit] == places, turns[j][2][own][hit], 0)
        enough = score >= least
        if enough.any():
            top_places = np.concatenate([top_places, places[enough] + edges[w]])
            top = np.concatenate([top, score[enough]])
            best = _best(top, top_places, ids, k)
            top_places, top = top_places[best], top[best]
            if len(top) == k:
                least = max(least, int(top[-1]))
    return top_places, top


def _ranked(size: Corpus, k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        weights = table["weight"].to_numpy()
        head = np.flatnonzero(np.isnan(weights.astype(float)))
        names, kinds = ["_item", "doc", "score"], [pa.int64()] * 3
        out: list[list[np.ndarray]] = [[], [], []]
        if len(head) and len(head) < len(weights):
            ids = np.asarray(table["ids"][int(head[0])].values)
            # the product of three counts may pass 64 bits, so it is taken in Python's integers
            m = np.array([75 + 25 * int(c) * size.documents // size.terms for c in np.asarray(table["counts"][int(head[0])].values)], np.int64)
            terms = table.filter(pa.array(weights == weights)).combine_chunks()
            places, counts, users = (terms[c].chunk(0) for c in ("places", "counts", "users"))
            ends = places.offsets.to_numpy()
            place, tf = np.asarray(places.values), np.asarray(counts.values).astype(np.int64)
            each = np.repeat(terms["weight"].to_numpy().astype(np.int64), np.diff(ends))
            place, tf = place[ends[0] : ends[-1]], tf[ends[0] : ends[-1]]
            adds = impacts(each, tf, m[place])
            ends = ends - ends[0]
            uses = users.offsets.to_numpy()
            item, times = (np.asarray(users.values.field(i))[uses[0] : uses[-1]] for i in range(2))
            term = np.repeat(np.arange(len(uses) - 1), np.diff(uses))
            order = np.argsort(item, kind="stable")
            cuts = np.flatnonzero(np.diff(item[order])) + 1
            for own in np.split(order, cuts):
                lists = [(place[ends[t] : ends[t + 1]], adds[ends[t] : ends[t + 1]] * q) for t, q in zip(term[own], times[own], strict=True)]
                found, score = rank(lists, ids, k)
                for column, values in zip(out, (np.full(len(found), item[own[0]]), ids[found], score), strict=True):
                    column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of ``build_index``'s table for every row of ``items(item_id, text)``.

    ``item_id, rank, doc_id, score``. Rows of one item id and one text are one item, an item id with
    several texts is ranked for each of them. Items without a known term (null and empty ones too)
    and documents without a term give no rows; an empty table on either side gives none. Equal scores
    go by id, a null id as the last one; documents that repeat an id are documents of their own.
    """
    asked = stage(items.select("item_id", "text").distinct().withColumn("_item", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-asked.count() // ITEMS))
    size = corpus(index)
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(1))
    used = asked.select("_item", F.explode(found).alias("term")).groupBy("_item", "term").agg(F.count("*").alias("times"))
    used = used.groupBy("term", F.pmod(F.hash("_item"), F.lit(groups)).alias("_group")).agg(F.collect_list(F.struct("_item", "times")).alias("users"))
    used = stage(used, "asked")
    known = index.where("term is not null")
    df = known.select("term", "df").join(used.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * size.documents + 2) / (2.0 * F.col("df") + 1))).cast("double")
    used = stage(used.join(df, "term").select("term", "_group", "users", weight.alias("weight")), "weighted")
    # a frequent term has a list in every block: its key is split as the blocks grow in number
    salts = max(1, -(-size.blocks // ROWS_PER_KEY))
    salted = used.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = known.withColumn("_salt", F.pmod(F.hash("block"), F.lit(salts))).join(salted, ["term", "_salt"])
    heads = index.where("term is null").withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["block", "_group", "weight", "places", "counts", "ids", "users"]
    none = F.lit(None)
    heads = heads.withColumn("weight", none.cast("double")).withColumn("users", none.cast(lists.schema["users"].dataType))
    both = lists.select(columns).unionByName(heads.select(columns))
    scored = both.groupBy("block", "_group").applyInArrow(_ranked(size, k), "_item bigint, doc bigint, score bigint")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), "doc")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked, "_item").select("item_id", "rank", F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "score")
