"""Quality rules: repetition by a word-level suffix array, beside plain counts.

The words of a document form a sequence. Prefix doubling sorts its suffixes; common-prefix
lengths of neighbours in that order give, for every place, the longest passage that starts
there and occurs again in the same document. The union of those passages and the longest of
them are limited. All documents of a slice are sorted together: a symbol is a pair of
document and word, so no match crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, longest_repeat bigint, repeat_chars bigint, repeat_spans bigint"
)


@dataclass(frozen=True)
class Limits:
    """``window``: words a repeated passage has at least. A document is rejected if it has
    fewer than ``min_words`` words, if more than ``max_percent`` % of its words lie in repeats,
    if more than ``max_char_percent`` % of its word bytes do, or if its longest repeat has more
    than ``max_longest`` words and more than ``max_longest_percent`` % of its words."""

    window: int = 8
    min_words: int = 20
    max_percent: int = 30
    max_char_percent: int = 35
    max_longest: int = 64
    max_longest_percent: int = 25


def suffix_levels(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ranks of all suffixes by their first 1, 2, 4, … symbols until all differ, and the
    suffixes still tied at each of these levels.

    Every repeated run of symbols must end before the end of the sequence (a closing symbol
    of its own sees to that). Only tied suffixes are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    by_first = symbols[order]
    ranks = np.empty(n, np.int64)
    ranks[order] = _group_starts(by_first)
    levels, tied, step = [ranks], [order[_repeated(by_first)]], 1
    while tied[-1].size:
        active = tied[-1]
        key = ranks[active] * n + ranks[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old, starts = ranks[active], _group_starts(key)
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], starts, 0))
        ranks = ranks.copy()
        ranks[active] = old + starts - group
        levels.append(ranks)
        tied.append(active[_repeated(key)])
        step *= 2
    return levels, tied


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each item of a sorted array, where its run of equal items starts."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _repeated(ordered: np.ndarray) -> np.ndarray:
    same = np.zeros(len(ordered), bool)
    if len(ordered) > 1:
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= ordered[1:] == ordered[:-1]
    return same


def longest_repeats(symbols: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of the longest passage from there that occurs elsewhere;
    0 where it is shorter than ``least`` symbols."""
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    levels, tied = suffix_levels(symbols)
    depth = max(0, least.bit_length() - 1)
    if depth >= len(levels) or not tied[depth].size:
        return best
    place = tied[depth]
    place = place[np.argsort(levels[-1][place], kind="stable")]
    left, right = place[:-1], place[1:]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = ranks[np.minimum(left + common, n - 1)] == ranks[np.minimum(right + common, n - 1)]
        common += np.where(same, 1 << level, 0)
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    best[best < least] = 0
    return best


def measure(ids: pa.Array, text: pa.Array, limits: Limits) -> pa.RecordBatch:
    """The result rows of one slice of documents."""
    n = len(ids)
    raw, offs = A.utf8(text)
    starts, lengths, row = A.words(raw, offs, A.NOT_SPACE)
    n_words = np.bincount(row, minlength=n)
    characters = A.NOT_SPACE[raw] & ((raw & 0xC0) != 0x80)
    word_chars = A.range_sums(characters, offs[:-1], offs[1:])
    word_bytes = A.per_row(lengths, row, n)
    n_symbols = A.range_sums(SYMBOLS[raw], offs[:-1], offs[1:])

    line_at, line_len = A.runs(raw != 0x0A, offs)
    worded = A.range_sums(A.NOT_SPACE[raw], line_at, line_at + line_len) > 0
    line_at, line_len = line_at[worded], line_len[worded]
    line_row = np.searchsorted(offs, line_at, "right") - 1
    keys = np.stack([line_row.astype(A.U64), A.piece_hashes(raw, line_at, line_len)])
    n_lines = np.bincount(line_row, minlength=n)
    distinct = np.unique(keys, axis=1)[0].astype(np.int64) if keys.size else np.zeros(0, np.int64)
    n_dup_lines = n_lines - np.bincount(distinct, minlength=n)

    # a closing symbol per document keeps repeats inside it
    hashes = A.piece_hashes(raw, starts, lengths)
    place = np.arange(len(starts)) + row
    symbols = np.zeros(len(starts) + n, A.U64)
    salt = A.mix(np.arange(1, n + 1, dtype=A.U64))
    symbols[place] = A.mix(hashes + salt[row])
    closing = np.cumsum(n_words + 1) - 1
    symbols[closing] = A.mix(salt ^ A.U64(0x5851F42D4C957F2D))
    repeats = longest_repeats(symbols, limits.window)[place]

    hit = np.flatnonzero(repeats)
    inside = A.covered(len(starts), hit, repeats[hit])
    n_repeat = np.bincount(row[inside], minlength=n)
    repeat_chars = A.per_row(lengths[inside], row[inside], n)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    spans = np.bincount(row[opens], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, repeats)

    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_percent * n_words)
    too_long = (longest > limits.max_longest) & (100 * longest > limits.max_longest_percent * n_words)
    kept = ~failed & (100 * repeat_chars <= limits.max_char_percent * word_bytes) & ~too_long
    values = [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]
    tail = [longest, repeat_chars, spans]
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), *(pa.array(v, pa.int64()) for v in values), pa.array(failed), pa.array(kept),
         *(pa.array(v, pa.int64()) for v in tail)],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict for every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail; repeated rows and null ids are judged row by
    row; other columns are ignored; an empty table gives an empty result. No shuffle: a row is
    judged alone, and a slice of at most a few megabytes (or one longer text) is in memory.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                yield measure(part.column(0), part.column(1), limits)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All columns of the rows that the rules keep, judged in the same pass."""
    carry = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch):
                place = part.schema.get_field_index("text")
                verdict = measure(pa.array(np.zeros(part.num_rows, np.int64)), part.column(place), limits)
                yield part.filter(verdict.column(verdict.schema.get_field_index("kept")))

    return docs.select(*carry).mapInArrow(judge, docs.schema)
