"""Benchmark decontamination by winnowing.

Of every window of ten words the four-word gram with the smallest hash is its fingerprint, so
a shared window always shares a fingerprint. Fingerprints of documents and benchmark are
joined; only around a hit are whole windows of the document compared with the benchmark's,
word by word. Benchmark items shorter than a window are one gram of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import arrays as A
from .rows import LAST_ID, unwrapped, wrapped

WINDOW = 10
GRAM = 4
#: Bits of the table that spares documents' fingerprints no benchmark item has: a fixed size
#: (a kilobyte per 8192 bits) at any size of either input. The join decides, not the table.
FILTER_BITS = 20

GRAMS = "_id bigint, _hash bigint, at int, n int, h bigint, n_words bigint"


class Grams:
    """Words of a slice of rows and their hashed grams."""

    def __init__(self, text: pa.Array) -> None:
        raw, offs = A.utf8(text)
        self.folded = A.lower_ascii(raw)
        self.starts, self.lengths, self.row = A.words(self.folded, offs, A.ALNUM)
        self.hashes = A.piece_hashes(self.folded, self.starts, self.lengths)
        self.n_words = np.bincount(self.row, minlength=len(text))
        self.first = np.cumsum(self.n_words) - self.n_words

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of all grams of n words that lie in one row."""
        h = A.window_hashes(self.hashes, n) ^ A.mix(np.array([n], A.U64))[0]
        same = self.row[: len(h)] == self.row[n - 1 :]
        return np.flatnonzero(same), h[same]

    def winnowed(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the leftmost smallest gram of every window."""
        h = A.window_hashes(self.hashes, gram) ^ A.mix(np.array([window], A.U64))[0]
        width = window - gram + 1
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, A.U64)
        low = h[:n].copy()
        for j in range(1, width):
            np.minimum(low, h[j : j + n], out=low)
        at = np.zeros(n, np.int64)
        for j in range(width - 1, -1, -1):
            own = h[j : j + n] == low
            at[own] = np.flatnonzero(own) + j
        at = np.unique(at[self.row[:n] == self.row[window - 1 :]])
        return at, h[at]

    def window(self, at: int, n: int) -> str:
        return " ".join(
            self.folded[s : s + k].tobytes().decode() for s, k in zip(self.starts[at : at + n], self.lengths[at : at + n], strict=True)
        )


def benchmark_windows(bench: DataFrame, window: int) -> DataFrame:
    """``item, window, n``: every window of every item, as words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                grams, rows = Grams(part.column(1)), []
                for item, words, first in zip(part.column(0).to_pylist(), grams.n_words.tolist(), grams.first.tolist(), strict=True):
                    n = min(window, words)
                    rows += [(item, grams.window(first + i, n), n) for i in range(words - n + 1) if n]
                columns = zip(*rows, strict=True) if rows else ((), (), ())
                kinds = (pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "window", "n"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    return bench.select(item.alias("item"), "text").mapInArrow(run, "item string, window string, n int").distinct()


def window_grams(windows: DataFrame, window: int, gram: int) -> DataFrame:
    """``n, h``: the distinct fingerprints of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for n in np.unique(sizes):
                grams = Grams(batch.column(0).filter(pa.array(sizes == n)))
                h = grams.winnowed(window, gram)[1] if n == window else grams.of(int(n))[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], names=["n", "h"])

    return windows.select("window", "n").distinct().mapInArrow(run, "n int, h bigint").distinct()


def document_grams(docs: DataFrame, fingerprints: DataFrame, window: int, gram: int) -> DataFrame:
    """Fingerprints of rows of ``docs(_id, _hash, text)`` that the benchmark may have, and for
    every row one entry with ``at`` -1 and its number of words."""
    bit = F.pmod("h", F.lit(1 << FILTER_BITS)).cast("int")
    # at most 2**FILTER_BITS numbers and WINDOW lengths come to the driver
    set_bits = [r["bit"] for r in fingerprints.select(bit.alias("bit")).distinct().collect()]
    short = sorted(r["n"] for r in fingerprints.where(F.col("n") < window).select("n").distinct().collect())
    table = np.zeros(1 << FILTER_BITS, bool)
    table[set_bits] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed.value).astype(bool)
        names = [c.split()[0] for c in GRAMS.split(", ")]
        for batch in batches:
            for part in A.slices(batch):
                ids, keys = (part.column(i).to_numpy() for i in range(2))
                grams = Grams(part.column(2))
                found = [(window, *grams.winnowed(window, gram)), *((n, *grams.of(n)) for n in short)]
                everyone = np.arange(len(ids))
                out = [(everyone, np.full(len(ids), -1), np.zeros(len(ids)), np.zeros(len(ids), np.int64))]
                for n, at, h in found:
                    own = known[(h & A.U64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                    at, h = at[own], h[own]
                    row = grams.row[at]
                    out.append((row, at - grams.first[row], np.full(len(at), n), h.view(np.int64)))
                row, at, n, h = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(keys[row]), pa.array(at, pa.int32()), pa.array(n, pa.int32()),
                     pa.array(h), pa.array(grams.n_words[row], pa.int64())], names=names,
                )

    return docs.select("_id", "_hash", "text").mapInArrow(run, GRAMS)


def _candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``_id, _hash, start, n, window``: document windows around the hits, as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                grams, rows = Grams(part.column(2)), []
                columns = (part.column(0), part.column(1), part.column(3))
                for i, (key, known, hits) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                    first, words = int(grams.first[i]), int(grams.n_words[i])
                    places: set[tuple[int, int]] = set()
                    for hit in hits:
                        n = hit["n"]
                        reach = window - gram if n == window else 0
                        places |= {(s, n) for s in range(max(0, hit["at"] - reach), min(hit["at"], words - n) + 1)}
                    rows += [(key, known, s, n, grams.window(first + s, n)) for s, n in sorted(places)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                filled = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(filled, kinds, strict=True)], names=["_id", "_hash", "start", "n", "window"]
                )

    return docs.select("_id", "_hash", "text", "hits").mapInArrow(run, "_id bigint, _hash bigint, start int, n int, window string")


def _spans(places: Column) -> Column:
    """Number of words in the union of spans ``(start, n)`` sorted by start."""
    step = lambda acc, x: F.struct(
        (acc["words"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("words"),
        F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
    )
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(places), zero, step)["words"]


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Hit words and items of every row of ``docs(doc_id, text)`` against ``bench(item_id, text)``.

    Null and wordless texts and items match nothing. Items with one id are one item; a null
    item id reads ``null``. Rows with one id and one text are alike and each is returned; null
    ids are kept. Other columns are ignored. An empty table on either side gives no hits.
    """
    marked = wrapped(docs.select("doc_id", "text")).drop("_row")
    windows = stage(benchmark_windows(bench, window), "windows")
    fingerprints = stage(window_grams(windows, window, gram), "grams")
    seen = stage(document_grams(marked, fingerprints, window, gram), "docgrams")
    hits = seen.where("at >= 0").join(fingerprints, ["n", "h"], "left_semi")
    hits = hits.groupBy("_id", "_hash").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    found = _candidates(marked.join(hits, ["_id", "_hash"]), window, gram).distinct()
    found = stage(found.join(windows.select("window").distinct(), "window", "left_semi"), "found")
    words = found.groupBy("_id", "_hash").agg(_spans(F.collect_list(F.struct("start", "n"))).cast("long").alias("n_hit"))
    items = found.select("_id", "_hash", "window").distinct().join(windows.select("item", "window"), "window")
    items = items.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = seen.where("at < 0").select("_id", "_hash", "n_words")
    joined = rows.join(words, ["_id", "_hash"], "left").join(items, ["_id", "_hash"], "left")
    named = F.coalesce(F.array_join("items", ","), F.lit(""))
    return joined.select(
        F.when(F.col("_id") != LAST_ID, F.col("_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "_hash",
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of the rows without a hit word."""
    bad = contamination(docs, bench, window, gram).where("contaminated")
    bad = bad.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), "_hash").distinct()
    return unwrapped(wrapped(docs).join(bad, ["_id", "_hash"], "left_anti"), docs.columns)
