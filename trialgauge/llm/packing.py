"""Packing: minimum bin slack over the multiset of remaining lengths.

Documents become token ids and one closing id, full windows are cut off, and what is left of
each document is a remainder shorter than a window. How many remainders of each length exist
is a table of at most ``capacity`` counts, whatever the input. On those counts a bitset
subset-sum picks, for the longest length left, the multiset that fills a window closest to
its capacity, and uses it as often as the counts allow; each pattern uses up a length, so
the plan is bounded too. The plan says which ranks of a length go where, and every remainder
finds its own place from its rank: nothing is gathered.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_position
from ..plans.staging import stage

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
CAPACITY = 2048
CLOSING_ID = 1
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: The added tokens of ``byte_bpe_50k.json``, which the rank file does not list.
ADDED_TOKENS = {"<|endoftext|>": 50256}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


class ByteBpe:
    """Ids of whole texts under the named vocabulary; the added token in a text is its own id.

    The file lists the ranks of the vocabulary ``byte_bpe_50k.json``; the ids are the same, in a
    third of the time (a test compares both).
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS
        )

    def ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all")


def token_pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """Windows of ``capacity`` ids and the remainder of every row of ``docs(doc_id, text)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe(path)
        for batch in batches:
            rows: list[tuple] = []
            ids_of: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(coder.ids(text.as_py() or ""), np.uint32(CLOSING_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity]
                    rows.append((doc_id.as_py(), start, len(own), zlib.crc32(own.tobytes()), len(ids)))
                    if with_ids:
                        ids_of.append(own.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset with the longest length left whose sum comes closest to ``capacity``.

    Bit s of a bitset says that sum s can be reached; a length with count c enters in
    powers of two, and the states are kept so that the sum can be traced back to counts.
    """
    longest = max(counts)
    room = capacity - longest
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            left, part = left - take, part * 2
    at, used = reach.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns and how often each is used, until no length is left."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        used = best_fill(counts, capacity)
        times = min(counts[length] // n for length, n in used.items())
        out.append((times, used))
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return out


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows of length, first rank, copies in a window, first sequence, offset; by length and rank."""
    rows, rank, sequence = [], {}, 0
    for times, used in patterns:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = rank.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            rank[length] = first + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(lengths: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the remainders with these lengths and ranks in their length."""
    at = np.zeros(len(lengths), np.int64)
    for length in np.unique(lengths):
        low, high = np.searchsorted(places[:, 0], [length, length + 1])
        own = lengths == length
        at[own] = low + np.searchsorted(places[low:high, 1], ranks[own], "right") - 1
    _, first, n, sequence, offset = places[at].T
    return sequence + (ranks - first) // n, offset + (ranks - first) % n * lengths


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs(doc_id, text)``, with its sequence and offset.

    Null and empty texts are a single closing id. Repeated rows are packed each on its own;
    null ids are kept. Other columns are ignored. An empty table gives an empty result. The
    driver holds a count per length (at most ``capacity`` numbers) and the plan.
    Remainder windows come first; whole windows follow, one sequence each. ``with_ids`` adds
    the ids themselves.
    """
    pieces = stage(token_pieces(docs, capacity, path or tokenizer_path(), with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    whole = histogram.pop(capacity, 0)
    patterns = plan(histogram, capacity)
    places = _places(patterns)
    if whole:
        # a whole window is a pattern of its own
        places = np.vstack([places, [[capacity, 0, 1, sum(times for times, _ in patterns), 0]]]).astype(np.int64)
    schema = f"{PIECES}{', ids array<int>' if with_ids else ''}, sequence_id bigint, offset bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            lengths, rank = (got[n].to_numpy() for n in ("length", "_rank"))
            got["sequence_id"], got["offset"] = map(pa.array, place(lengths, rank - 1, places))
            yield pa.RecordBatch.from_arrays([got[n] for n in names], names=names)

    # a frequent length is ranked over many ranges; pieces alike in all of these are interchangeable
    order = [F.asc(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    return with_position(pieces, order, ["length"], "_rank", None).mapInArrow(assign, schema)
