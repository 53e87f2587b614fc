"""Vectorised text primitives for Arrow batches: byte views, words, hashes, slices.

Everything here works on one slice of documents inside a task. Slices are bounded in
bytes, so memory does not follow the batch; a single longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)
_MIX2 = U64(0xD6E8FEB86659FD93)
_LONG_PIECE = 512


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that hold about ``limit`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * _MIX2
    return (h ^ (h >> U64(29))) * _MIX


def lanes(raw: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte words starting at every byte; bytes past the end read as zero."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def piece_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice, equal for equal slices wherever they lie."""
    view = lanes(raw)
    h = mix(lengths.astype(U64) + _MIX)
    long = lengths > _LONG_PIECE
    todo = np.flatnonzero((lengths > 0) & ~long)
    at = 0
    while todo.size:
        left = np.minimum(lengths[todo] - at, 8).astype(U64)
        lane = view[starts[todo] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((U64(8) - left) * U64(8)))
        h[todo] = mix(h[todo] * _MIX ^ lane)
        at += 8
        todo = todo[lengths[todo] > at]
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes(), 7)
    return h


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words split on white space, and of words made of letters and digits.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal true runs that do not cross a row boundary."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and row numbers of the words of every row."""
    starts, lengths = runs(table[raw], offsets)
    return starts, lengths, np.searchsorted(offsets, starts, "right") - 1


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items; entry i covers items i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = (out + hashes[j : j + n]) * _MIX
    return mix(out)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def range_sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:n]) > 0
