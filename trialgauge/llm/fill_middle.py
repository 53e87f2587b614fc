"""Fill-in-the-middle texts by secondary sort.

A map pass cuts every text at two unit borders and emits bounded pieces, each keyed by its
document and its place in the output. One exchange by document with a sort by place inside
the partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``) lets a task
stream the pieces of one document after the other into a running digest, whatever its length.
Restoring reads that output stream alone: the sentinels found in it tell the sections, which
a second sort inside the same partitions puts back into the order of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

# fixed values: sentinels of the output format
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LETTER = A.byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Most bytes of text in a piece, which ends where a unit does.
PIECE = 1 << 16
#: Bytes of pieces in a batch that a task hands on.
BATCH = 4 << 20


@dataclass(frozen=True)
class Recipe:
    """Shares of the forms in percent, and the seed of the cuts."""

    fim_percent: int = 90
    spm_percent: int = 20
    seed: int = 1


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from the id; a null id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def unit_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte at which every unit starts: a run of ASCII letters or any other code point."""
    letter = LETTER[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first |= letter & edge[:-1]
    return np.flatnonzero(first | ~letter & ((raw & 0xC0) != 0x80))


PIECES = "_key bigint, _ord bigint, place int, doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, piece binary"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of a bounded weight."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row) + 64
        if size > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    filled = zip(*held, strict=True) if held else [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(filled, kinds, strict=True)], names=names)


def _cut(view: memoryview, borders: np.ndarray, low: int, high: int) -> Iterator[bytes]:
    """Consecutive pieces of a section, ended at unit borders."""
    while high - low > PIECE:
        at = int(np.searchsorted(borders, low + PIECE, "right")) - 1
        # a longer unit is a run of ASCII letters and may be cut at any byte
        stop = int(borders[at]) if borders[at] > low else low + PIECE
        yield bytes(view[low:stop])
        low = stop
    if low < high:
        yield bytes(view[low:high])


def _pieces(recipe: Recipe) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ordinal = 0
        for batch in batches:
            for part in A.slices(batch):
                raw, offs = A.utf8(part.column(2))
                starts = unit_starts(raw, offs)
                leads = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
                unit = np.searchsorted(starts, offs)
                view = memoryview(raw.tobytes())
                keys, ids, h1, h2, h3, h4 = (part.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
                for i, (key, doc) in enumerate(zip(keys, ids, strict=True)):
                    begin, end, n = int(offs[i]), int(offs[i + 1]), int(unit[i + 1] - unit[i])
                    text = bytes(view[begin:end])
                    borders = starts[unit[i] : unit[i + 1]]
                    plain = not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3[i] % 100 >= recipe.fim_percent
                    if plain:
                        form, sections, chars = "plain", [(b"", begin, end)], (None, None)
                    else:
                        low, high = (int(borders[c]) if c < n else end for c in sorted((h1[i] % (n + 1), h2[i] % (n + 1))))
                        before, within, after = (PREFIX, begin, low), (MIDDLE, low, high), (SUFFIX, high, end)
                        form = "spm" if h4[i] % 100 < recipe.spm_percent else "psm"
                        sections = [after, before, within] if form == "spm" else [before, after, within]
                        chars = (int(leads[low] - leads[begin]), int(leads[high] - leads[low]))
                    place = 0
                    for mark, low, high in sections:
                        cut = _cut(view, borders, low, high)
                        yield (key, ordinal, place, doc, n, form, *chars, mark + next(cut, b""))
                        place += 1
                        for piece in cut:
                            yield (key, ordinal, place, None, None, None, None, None, piece)
                            place += 1
                    ordinal += 1

    return lambda batches: _batches(rows(batches), _NAMES, _KINDS, lambda r: len(r[-1]))


SECTIONS = f"{PIECES}, section int, output_sha256 string"
_SECTION_NAMES = [*_NAMES, "section", "output_sha256"]
_SECTION_KINDS = [*_KINDS, pa.int32(), pa.string()]
_TURN = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_HEAD = -1


class _Restorer:
    """Sections of one output, from its form and its bytes as they stream by."""

    def __init__(self, form: str) -> None:
        self.plain = form == "plain"
        self.section = 0
        self.tail = b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        if self.plain:
            if data:
                yield 0, data
            return
        data = self.tail + data
        at = 0
        while (found := min((p, s) if (p := data.find(s, at)) >= 0 else (len(data), b"") for s in _TURN))[1]:
            if found[0] > at:
                yield self.section, data[at : found[0]]
            self.section, at = _TURN[found[1]], found[0] + len(found[1])
        # a sentinel may go on in the next piece
        keep = 0 if last else min(len(data) - at, 2)
        self.tail = data[len(data) - keep :]
        if len(data) - keep > at:
            yield self.section, data[at : len(data) - keep]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every output, and the pieces of its sections as found in the output."""

    def rows() -> Iterator[tuple]:
        now, head, digest, restorer, turn = None, None, None, None, 0

        def close() -> Iterator[tuple]:
            nonlocal turn
            if now is not None:
                for section, piece in restorer.feed(b"", True):
                    yield (*now, turn, None, None, None, None, None, piece, section, None)
                    turn += 1
                yield (*now, 0, *head, b"", _HEAD, digest.hexdigest())

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES]
            for key, ordinal, _, doc, n, form, before, within, piece in zip(*columns, strict=True):
                if (key, ordinal) != now:
                    yield from close()
                    now, head, digest, restorer, turn = (key, ordinal), (doc, n, form, before, within), hashlib.sha256(), _Restorer(form), 0
                digest.update(piece)
                for section, part in restorer.feed(piece):
                    yield (key, ordinal, turn, None, None, None, None, None, part, section, None)
                    turn += 1
        yield from close()

    return _batches(rows(), _SECTION_NAMES, _SECTION_KINDS, lambda r: len(r[8]))


RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_RESULT_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, its sections digested in the order of the text."""

    def rows() -> Iterator[tuple]:
        head, digest = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*_NAMES[3:], "section", "output_sha256")]
            for *known, piece, section, output in zip(*columns, strict=True):
                if section == _HEAD:
                    if head is not None:
                        yield (*head, digest.hexdigest())
                    head, digest = (*known, output), hashlib.sha256()
                else:
                    digest.update(piece)
        if head is not None:
            yield (*head, digest.hexdigest())

    return _batches(rows(), _RESULT_NAMES, _RESULT_KINDS, lambda r: 200)


def pieces(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Pieces of every output in its document's partition, sorted by place: ``piece`` joined over
    ``place`` is the output of ``(_key, _ord)``; the first piece carries the document's columns.

    The key follows from id, text and input partition, and the ordinal tells rows of one key apart,
    so repeated rows stay rows of their own and a row that a third of the table repeats is spread.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.spark_partition_id()).alias("_key")
    numbers = [c.alias(f"_h{i}") for i, c in enumerate(draws(F.col("doc_id"), recipe.seed))]
    cut = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), "text", *numbers).mapInArrow(_pieces(recipe), PIECES)
    return cut.repartition("_key").sortWithinPartitions("_key", "_ord", "place")


def fill_middle(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Form, cuts and digests of the fill-in-the-middle output of every row of ``docs(doc_id, text)``.

    A null or empty text is plain with no unit and the digest of no bytes. A text that holds a
    sentinel is plain. A null id draws as the word ``null``. Every row gives a row, repeated rows
    too; other columns are ignored. An empty table gives no rows. Texts of any length pass in pieces.
    """
    found = pieces(docs, recipe).mapInArrow(_assemble, SECTIONS)
    return found.sortWithinPartitions("_key", "_ord", "section", "place").mapInArrow(_restore, RESULT)


def outputs(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """``doc_id, form, output``: whole transformed texts for training, one row per row of ``docs``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, head, parts = None, None, []
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES]
                for key, ordinal, _, doc, _, form, _, _, piece in zip(*columns, strict=True):
                    if (key, ordinal) != now:
                        if now is not None:
                            yield (*head, b"".join(parts).decode())
                        now, head, parts = (key, ordinal), (doc, form), []
                    parts.append(piece)
            if now is not None:
                yield (*head, b"".join(parts).decode())

        return _batches(rows(), ["doc_id", "form", "output"], [pa.int64(), pa.string(), pa.string()], lambda r: len(r[2]))

    return pieces(docs, recipe).mapInArrow(join, "doc_id bigint, form string, output string")


def restored(form: str, output: str) -> str:
    """The text of one output."""
    sections: list[list[bytes]] = [[], [], []]
    reader = _Restorer(form)
    for section, part in [*reader.feed(output.encode()), *reader.feed(b"", True)]:
        sections[section].append(part)
    return b"".join(part for section in sections for part in section).decode()
