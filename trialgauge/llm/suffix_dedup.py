"""Exact substring deduplication by a distributed merge of front-coded sorted suffix runs.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller id. Sorting every suffix would move each byte fifty times, so suffixes are sampled by
content: every string of ``LENGTH`` bytes has one anchor, the place of its ``GRAM`` bytes with
the smallest hash, and equal strings have it at the same offset. Of an anchor, the suffix from
it on and the bytes before it that its strings cover are kept.

1. A task sorts the anchors of a few megabytes of text by suffix, settles equal ones among
   themselves, and sends what is left as front-coded runs: of each suffix only what differs
   from its predecessor.
2. A task gets the runs of one share of the grams and merges them in a loser tree that
   carries common-prefix lengths: known prefixes are never compared again, and the merged
   suffixes come with their common prefixes. Intervals of those, with the order of the bytes
   before the anchors, say which strings are equal, and the smallest id decides.
3. Spans meet the texts of their documents, and bytes are cut.

Runs, spans and texts travel as compressed blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .rows import LAST_ID, order_id

LENGTH = 50
GRAM = 8
#: Bytes an anchor's strings reach back at most.
BACK = LENGTH - GRAM
RUN_BYTES = 8 << 20
HASH_BYTES = 1 << 20
#: Anchors of one run at most.
RUN_ANCHORS = 500_000

SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
BLOCK = "part int, kind int, block binary"
RUN, SPANS, TEXTS = 0, 1, 2


# ---- blocks ----------------------------------------------------------------------------------


def _block(*columns: np.ndarray) -> bytes:
    """Arrays of any kinds and sizes as one compressed string of bytes."""
    head = ";".join(f"{c.dtype.str},{c.size}" for c in columns).encode()
    packer = zstandard.ZstdCompressor(level=3)
    parts = [packer.compress(np.ascontiguousarray(c).tobytes()) for c in columns]
    sizes = np.array([len(head), *map(len, parts)], "<u4").tobytes()
    return bytes([len(parts)]) + sizes + head + b"".join(parts)


def _unblock(block: bytes) -> list[np.ndarray]:
    n = block[0]
    sizes = np.frombuffer(block, "<u4", n + 1, 1).astype(int)
    at = 1 + 4 * (n + 1)
    kinds = block[at : at + sizes[0]].decode().split(";")
    at += sizes[0]
    out, unpack = [], zstandard.ZstdDecompressor()
    for size, kind in zip(sizes[1:], kinds, strict=True):
        dtype, count = kind.split(",")
        plain = unpack.decompress(block[at : at + size], max_output_size=int(count) * np.dtype(dtype).itemsize + 1)
        out.append(np.frombuffer(plain, dtype))
        at += size
    return out


def _by_document(docs: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of each item's document inside the block, and the block's documents."""
    used, own = np.unique(docs, return_inverse=True)
    order = np.argsort(ids[used], kind="stable")
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    used = used[order]
    steps = np.diff(ids[used], prepend=0)
    narrow = np.uint16 if len(used) < 1 << 16 else np.uint32
    return turn[own].astype(narrow), steps, keys[used].astype(np.uint32)


# ---- sampled suffixes -------------------------------------------------------------------------


class Anchors(NamedTuple):
    at: np.ndarray  # place of the gram in the raw bytes
    back: np.ndarray  # bytes before it that its strings cover
    ahead: np.ndarray  # bytes from it on that they cover


def anchors(raw: np.ndarray, offs: np.ndarray) -> Anchors:
    """The anchors of all strings of ``LENGTH`` bytes of every row."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(3)))
    # hash in the upper bits, place in the lower: the smallest is the leftmost of the smallest
    bits = A.U64(int(len(raw)).bit_length())
    h = A.mix(np.ascontiguousarray(A.lanes(raw)[: len(raw)]) + A.U64(1)) >> bits << bits | np.arange(len(raw), dtype=A.U64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    low = np.minimum(h[:n], h[width - step : width - step + n])
    place = (low & ((A.U64(1) << bits) - A.U64(1))).astype(np.int64)
    whole = np.ones(n, bool)
    for end in offs[1:-1]:
        whole[max(0, end - LENGTH + 1) : end] = False
    start = np.flatnonzero(whole)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(start) - 1] if len(first) else first
    at = place[first]
    return Anchors(at, at - start[first], start[last] + LENGTH - at)


def _windows(raw: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from each place on in steps of 1 or -1, zero beyond the size."""
    reach = np.arange(width)
    out = raw[np.clip(at[:, None] + step * reach, 0, max(len(raw) - 1, 0))]
    out[reach >= size[:, None]] = 0
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def _sortable(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _unite(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans of each document."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    # documents one after another on one line, so that a running maximum stays inside each
    span = int(ends.max()) + 1
    reach = np.maximum.accumulate(docs * span + ends)
    new = np.ones(len(docs), bool)
    new[1:] = docs[1:] * span + starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(docs) - 1]
    return docs[first], starts[first], reach[last] - docs[first] * span


def make_runs(raw: np.ndarray, offs: np.ndarray, ids: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted front-coded runs of a few megabytes of text, one per share of the grams, and the
    spans that these texts settle among themselves."""
    found = list(_sampled(raw, offs))
    if not found:
        return
    at, back, ahead = (np.concatenate(x) for x in zip(*found, strict=True))
    for first in range(0, len(at), RUN_ANCHORS):
        part = slice(first, first + RUN_ANCHORS)
        yield from _run_blocks(raw, offs, ids, keys, parts, Anchors(at[part], back[part], ahead[part]))


def _sampled(raw: np.ndarray, offs: np.ndarray) -> Iterator[Anchors]:
    """Anchors of all rows, hashed a bounded number of bytes at a time; longer rows in pieces
    that overlap by a string less a byte."""
    row = 0
    while row < len(offs) - 1:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + HASH_BYTES, "right")) - 1)
        low, high = int(offs[row]), int(offs[stop])
        for start in range(low, max(low + 1, high - LENGTH + 1), HASH_BYTES if stop == row + 1 else high - low + 1):
            end = min(high, start + HASH_BYTES + LENGTH - 1) if stop == row + 1 else high
            inner = np.clip(offs[row : stop + 1], start, end) - start
            own = anchors(raw[start:end], inner)
            yield Anchors(own.at + start, own.back, own.ahead)
        row = stop


def _run_blocks(raw, offs, ids, keys, parts, own_anchors: Anchors) -> Iterator[tuple[int, int, bytes]]:
    at, back, ahead = own_anchors
    docs = np.searchsorted(offs, at, "right") - 1
    gram = np.ascontiguousarray(A.lanes(raw)[at])
    share = (A.mix(gram ^ A.U64(0xA5A5A5A5)) % A.U64(parts)).astype(np.int64)
    settled = [(np.zeros(0, np.int64),) * 3]
    order = np.argsort(share, kind="stable")
    edges = np.searchsorted(share[order], np.arange(parts + 1))
    for part in range(parts):
        own = order[edges[part] : edges[part + 1]]
        if not own.size:
            continue
        suffix = _windows(raw, at[own], ahead[own], LENGTH, 1)
        before = _windows(raw, at[own] - 1, back[own], BACK, -1)
        whole = np.hstack([suffix, before, ahead[own, None].astype(np.uint8), back[own, None].astype(np.uint8)])
        # equal contexts: only those of the smallest id go on, the rest are settled
        by = np.lexsort((ids[docs[own]], _sortable(whole)))
        own, suffix, before, whole = own[by], suffix[by], before[by], whole[by]
        new = _common(whole) < whole.shape[1]
        if len(new):
            new[0] = True
        lowest = ids[docs[own]][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = ids[docs[own]] > lowest
        gone = own[later]
        settled.append((docs[gone], at[gone] - back[gone] - offs[docs[gone]], at[gone] + ahead[gone] - offs[docs[gone]]))
        own, suffix, before = own[~later], suffix[~later], before[~later]
        same = _common(suffix)
        reach = np.arange(LENGTH)
        tails = suffix[(reach >= same[:, None]) & (reach < ahead[own, None])]
        heads = before[np.arange(BACK) < back[own, None]]
        number, steps, marks = _by_document(docs[own], ids, keys)
        u8 = [x.astype(np.uint8) for x in (same, ahead[own], back[own])]
        yield part, RUN, _block(*u8, tails, heads, number, (at[own] - offs[docs[own]]).astype(np.uint32), steps, marks)
    yield from _span_blocks(*(np.concatenate(x) for x in zip(*settled, strict=True)), ids, keys, parts)


def bucket(ids: np.ndarray, parts: int) -> np.ndarray:
    return (A.mix(ids.astype(np.int64).view(A.U64) + A.U64(17)) % A.U64(parts)).astype(np.int64)


def _span_blocks(docs, starts, ends, ids, keys, parts) -> Iterator[tuple[int, int, bytes]]:
    docs, starts, ends = _unite(docs, starts, ends)
    where = bucket(ids[docs], parts)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(edges)):
        own = order[edges[part] : edges[part + 1]]
        number, steps, marks = _by_document(docs[own], ids, keys)
        yield int(part), SPANS, _block(number, starts[own].astype(np.uint32), (ends - starts)[own].astype(np.uint32), steps, marks)


# ---- merging ----------------------------------------------------------------------------------


class Run(NamedTuple):
    same: np.ndarray
    ahead: np.ndarray
    back: np.ndarray
    suffix: np.ndarray
    before: np.ndarray
    ids: np.ndarray
    marks: np.ndarray
    at: np.ndarray


def read_run(block: bytes) -> Run:
    same, ahead, back, tails, heads, number, at, steps, marks = _unblock(block)
    n = len(same)
    reach = np.arange(LENGTH)
    suffix = np.zeros((n, LENGTH), np.uint8)
    suffix[(reach >= same[:, None]) & (reach < ahead[:, None])] = tails
    # undo the front coding: a byte inside the shared prefix is that of the last row that states it
    for column in range(int(same.max(initial=0))):
        stated = np.maximum.accumulate(np.where(same <= column, np.arange(n), 0))
        suffix[:, column] = np.where(column < ahead, suffix[stated, column], 0)
    before = np.zeros((n, BACK), np.uint8)
    before[np.arange(BACK) < back[:, None]] = heads
    ids = np.cumsum(steps)
    return Run(same, ahead.astype(np.int64), back.astype(np.int64), suffix, before, ids[number], marks[number], at.astype(np.int64))


def merge(keys: list[list[int]], same: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs of ``LENGTH``-byte numbers in a loser tree with common prefixes.

    ``same[r][i]`` is the common prefix, in bytes, of item i of run r with the item before it.
    Returns the run of each item in order and its common prefix with the item before. Each
    run's head carries its common prefix with the last item put out: the longer one is the
    smaller item, and only heads with equal ones are compared, beyond that prefix.
    """
    k = len(keys)
    size = [len(x) for x in keys]
    at, shared, head = [0] * k, [0] * k, [x[0] for x in keys]
    losers = [0] * k
    width = 8 * LENGTH

    def settle(node: int) -> int:
        if node >= k:
            return node - k
        a, b = settle(2 * node), settle(2 * node + 1)
        if shared[a] == shared[b]:
            common = (width - (head[a] ^ head[b]).bit_length()) >> 3
            if head[b] < head[a]:
                a, b = b, a
            shared[b] = common
        elif shared[b] > shared[a]:
            a, b = b, a
        losers[node] = b
        return a

    best = settle(1) if k > 1 else 0
    runs, prefix, left = [], [], sum(size)
    while left:
        runs.append(best)
        prefix.append(shared[best])
        left -= 1
        i = at[best] + 1
        at[best] = i
        if i < size[best]:
            head[best], shared[best] = keys[best][i], same[best][i]
        else:
            shared[best] = -1
        node = (k + best) >> 1
        while node:
            other = losers[node]
            mine, its = shared[best], shared[other]
            if its > mine:
                losers[node], best = best, other
            elif its == mine and mine >= 0:
                a, b = head[best], head[other]
                common = (width - (a ^ b).bit_length()) >> 3
                if b < a:
                    shared[best] = common
                    losers[node], best = best, other
                else:
                    shared[other] = common
            node >>= 1
    return np.array(runs, np.int64), np.array(prefix, np.int64)


def _tied(key: np.ndarray) -> np.ndarray:
    """Which items have a key that another has."""
    out = np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")
    s = key[order]
    if len(s) > 1:
        equal = s[1:] == s[:-1]
        out[order[1:]] = equal
        out[order[:-1]] |= equal
    return out


def repeated(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """Document id, mark, start and end of the spans to remove that a set of runs shows."""
    numbers = [[int.from_bytes(x, "big") for x in r.suffix.view(f"V{LENGTH}").ravel().tolist()] for r in runs]
    source, prefix = merge(numbers, [r.same.tolist() for r in runs])
    del numbers
    base = np.cumsum([0] + [len(r.same) for r in runs])[:-1]
    order = np.empty(len(source), np.int64)
    by_run = np.argsort(source, kind="stable")
    order[by_run] = np.concatenate([b + np.arange(len(r.same)) for b, r in zip(base, runs, strict=True)])
    ahead, back, before, ids, marks, at = (np.concatenate([getattr(r, f) for r in runs])[order] for f in ("ahead", "back", "before", "ids", "marks", "at"))

    # strings that begin in the first half of what lies before the anchor, or in the second
    half = BACK // 2
    deep = np.cumsum(prefix < LENGTH - half)
    shallow = np.cumsum(prefix < GRAM).astype(A.U64)
    words = np.zeros((len(before), 24), np.uint8)
    words[:, : half + 1] = before[:, : half + 1]
    lane = words.view("<u8")
    far = A.mix(A.mix(A.mix(lane[:, 0] + shallow * A.U64(0x9E3779B97F4A7C15)) ^ lane[:, 1]) * A.U64(3) ^ lane[:, 2])
    live = _tied(deep) | (_tied(far) & (back > half))
    live = np.flatnonzero(live)
    ahead, back, before, ids, marks, at = (x[live] for x in (ahead, back, before, ids, marks, at))
    m = len(live)
    by_left = np.argsort(_sortable(before), kind="stable")
    left_common = _common(before[by_left])
    gone = np.zeros((m, BACK + 2), bool)
    left = np.empty(m, np.int64)
    for offset in range(BACK + 1):
        there = np.flatnonzero((back >= offset) & (ahead >= LENGTH - offset))
        if len(there) < 2:
            continue
        right = np.cumsum(prefix < LENGTH - offset)[live]
        left[by_left] = np.cumsum(left_common < offset)
        key = (right * (m + 1) + left)[there]
        by = np.argsort(key, kind="stable")
        there, key = there[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        lowest = np.minimum.reduceat(ids[there], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone[there[ids[there] > lowest], offset] = True
    # runs of neighbouring offsets make one span
    opens = gone.copy()
    opens[:, 1:] &= ~gone[:, :-1]
    closes = gone.copy()
    closes[:, :-1] &= ~gone[:, 1:]
    item, low = np.nonzero(opens)
    _, high = np.nonzero(closes)
    return ids[item], marks[item], at[item] - high, at[item] - low + LENGTH


# ---- Spark ------------------------------------------------------------------------------------


def _blocks(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, block = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], names=["part", "kind", "block"])


def _runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, limit=RUN_BYTES):
                ids, keys = (part.column(i).to_numpy() for i in range(2))
                yield _blocks(list(make_runs(*A.utf8(part.column(2)), ids, keys & 0xFFFFFFFF, parts)))

    return run


def _texts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, limit=RUN_BYTES):
                ids, keys = (part.column(i).to_numpy() for i in range(2))
                where = bucket(ids, parts)
                rows = []
                for p in np.unique(where):
                    own = np.flatnonzero(where == p)
                    raw, offs = A.utf8(part.column(2).take(pa.array(own)))
                    null = part.column(2).take(pa.array(own)).is_null().to_numpy(zero_copy_only=False)
                    rows.append((int(p), TEXTS, _block(ids[own], (keys[own] & 0xFFFFFFFF).astype(np.uint32), offs, raw, null)))
                yield _blocks(rows)

    return run


def _merge(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = []
        for batch in batches:
            passed = []
            for part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == RUN:
                    runs.append(read_run(block))
                else:
                    passed.append((part, kind, block))
            yield _blocks(passed)
        runs = [r for r in runs if len(r.same)]
        if not runs:
            return
        ids, marks, starts, ends = repeated(runs)
        pairs, docs = np.unique(np.stack([ids, marks.astype(np.int64)]), axis=1, return_inverse=True)
        yield _blocks(list(_span_blocks(docs.ravel(), starts, ends, pairs[0], pairs[1], parts)))

    return run


def _cut(with_text: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = []
        spans = None
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == SPANS:
                    number, starts, sizes, steps, marks = _unblock(block)
                    columns.append([np.cumsum(steps)[number], marks[number].astype(np.int64), starts.astype(np.int64), sizes.astype(np.int64)])
                    continue
                if spans is None:
                    spans = Spans(columns)
                yield _cut_texts(_unblock(block), spans, names)

    return run


class Spans:
    """The spans of one bucket's documents, united."""

    def __init__(self, columns: list[list[np.ndarray]]) -> None:
        ids, marks, starts, sizes = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.zeros(0, np.int64),) * 4
        pairs, docs = np.unique(np.stack([ids, marks]), axis=1, return_inverse=True)
        docs, self.starts, self.ends = _unite(docs.ravel(), starts, starts + sizes)
        edges = np.searchsorted(docs, np.arange(pairs.shape[1] + 1)).tolist()
        self.place = {p: (edges[i], edges[i + 1]) for i, p in enumerate(map(tuple, pairs.T.tolist()))}

    def of(self, doc: int, mark: int) -> list[tuple[int, int]]:
        low, high = self.place.get((doc, mark), (0, 0))
        return list(zip(self.starts[low:high].tolist(), self.ends[low:high].tolist(), strict=True))


def _cut_texts(texts: list[np.ndarray], spans: Spans, names: list[str]) -> pa.RecordBatch:
    ids, marks, offs, raw, null = texts
    whole = raw.tobytes()
    rows = []
    for i, (doc, mark) in enumerate(zip(ids.tolist(), marks.tolist(), strict=True)):
        text, gone, at, kept = whole[offs[i] : offs[i + 1]], spans.of(doc, mark), 0, []
        for start, end in gone:
            kept.append(text[at:start])
            at = end
        kept = b"".join([*kept, text[at:]])
        row = (doc if doc != LAST_ID else None, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
        # a cut may fall inside a character; what is left of it is dropped from the text, not from the digest
        rows.append(row + ((None if null[i] else kept.decode("utf-8", "ignore"),) if "text" in names else ()))
    kinds = [pa.int64()] * 4 + [pa.string()] * (len(names) - 4)
    filled = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(filled, kinds, strict=True)], names=names)


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """What is left of every row of ``docs(doc_id, text)``.

    A null text is empty; a null id comes after every other; rows with one id are one document
    here, so none removes from another, and each is returned. Other columns are ignored. An
    empty table gives an empty result. ``with_text`` adds the text that is left (null stays null).
    Shares of the grams, and of the documents, are as many as ``spark.sql.shuffle.partitions``.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(order_id().alias("_id"), F.xxhash64("text").alias("_key"), "text")
    runs = rows.mapInArrow(_runs(parts), BLOCK)
    spans = runs.repartitionById(parts, F.col("part")).mapInArrow(_merge(parts), BLOCK)
    texts = rows.mapInArrow(_texts(parts), BLOCK)
    met = spans.union(texts).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    return met.mapInArrow(_cut(with_text), SCHEMA + (", text string" if with_text else ""))
