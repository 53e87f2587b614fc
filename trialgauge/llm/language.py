"""Language identification of mixed-language text, span by span.

Script ranges first narrow which learned languages a word can belong to. Each word is then
scored by a byte-trigram model per language, and a Viterbi pass over the words of a document,
with a penalty for switching, labels spans. The language with the most letters wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import drawn, top_per_group
from . import arrays as A

#: First and last code point of the ranges told apart.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
TABLE_BITS = 16
#: Stands for no trigram; its scores are zero.
NO_GRAM = 1 << TABLE_BITS
#: Text bytes of the slice of documents that go through the model at a time.
SLICE = 3 << 20
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_letters bigint, n_spans bigint, spans array<struct<lang:string,start:int,words:int>>"


@dataclass(frozen=True)
class Training:
    """The documented bound of the training sample: ``max_docs`` labelled documents of each language, those with the
    smallest hashes, so that a rare language is learned however large the table is. Their texts are
    learned from as a whole, in tasks; the driver gets one sum per trigram and language."""

    max_docs: int = 1000
    smoothing: float = 0.5
    switch_penalty: float = 12.0
    script_share: float = 0.001


def fold(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text; a null id is the text ``''``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its script number + 1, or 0 if no word holds it; whether it is a letter.

    All code points of the ranges above belong to words, marks included, and so does any other
    letter, as the script after the named ones.
    """
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.where(letter, len(SCRIPTS) + 1, 0).astype(np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1] = number
    return script, letter


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and value of every code point of valid UTF-8."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.zeros(len(raw) + 3, np.uint32)
    b[: len(raw)] = raw
    lead = b[at]
    value = lead.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        own = np.flatnonzero((lead >= low) & (lead < high))
        code = lead[own] & mask
        for step in range(1, more + 1):
            code = code << 6 | b[at[own] + step] & 0x3F
        value[own] = code
    return at, value


class Words:
    """The letter words of a slice of documents with their trigram features and script."""

    def __init__(self, text: pa.Array) -> None:
        raw, offs = A.utf8(text)
        at, value = code_points(raw)
        scripts, letters = letter_tables()
        kind = scripts[value]
        letter = np.zeros(len(raw), bool)
        letter[at] = kind > 0
        # continuation bytes go with their letter
        lead_of = np.zeros(len(raw), np.int64)
        lead_of[at] = at
        np.maximum.accumulate(lead_of, out=lead_of)
        letter = letter[lead_of] if len(raw) else letter
        self.starts, self.lengths = A.runs(letter, offs)
        self.row = np.searchsorted(offs, self.starts, "right") - 1
        letter_points = np.zeros(len(raw), np.int64)
        letter_points[at] = letters[value]
        self.letters = A.range_sums(letter_points, self.starts, self.starts + self.lengths)
        script_at = np.zeros(len(raw), np.uint8)
        script_at[at] = kind
        self.script = script_at[self.starts] if len(self.starts) else np.zeros(0, np.uint8)
        # trigrams of the lower-cased word between two blanks
        folded = A.lower_ascii(raw)
        size = int(self.lengths.sum() + 2 * len(self.lengths))
        ends = np.cumsum(self.lengths + 2)
        self.first = ends - self.lengths - 2
        padded = np.full(size + 2, 0x20, np.uint32)
        inner = np.ones(size, bool)
        inner[self.first] = False
        inner[ends - 1] = False
        padded[:size][inner] = folded[letter]
        grams = (padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)) * np.uint32(2654435761)
        grams >>= np.uint32(32 - TABLE_BITS)
        # the last two places of a word begin no trigram of it
        grams[ends - 1] = NO_GRAM
        grams[ends - 2] = NO_GRAM
        self.grams = grams

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Per word, the table rows of its trigrams added up."""
        if not len(self.starts):
            return np.zeros((0, table.shape[1]), np.float32)
        return np.stack([np.add.reduceat(column[self.grams], self.first) for column in table.T.copy()], axis=1)


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # trigram x language
    allowed: np.ndarray  # script x language

    @classmethod
    def fit(cls, rows: list, how: Training) -> Model:
        """From the sums that ``feature_counts`` gathered."""
        languages = sorted({r["lang"] for r in rows})
        number = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((1 << TABLE_BITS, len(languages)))
        scripts = np.zeros((len(SCRIPTS) + 2, len(languages)))
        for r in rows:
            at = np.array([x["at"] for x in r["sums"]], np.int64)
            n = np.array([x["n"] for x in r["sums"]], float)
            grams = at < NO_GRAM
            counts[at[grams], number[r["lang"]]] = n[grams]
            scripts[at[~grams] - NO_GRAM, number[r["lang"]]] = n[~grams]
        smooth = counts + how.smoothing
        # a language is a candidate for a script that makes up some share of its letters; an unseen script rules out none
        share = scripts / np.maximum(scripts.sum(0), 1)
        allowed = share >= how.script_share
        allowed[~allowed.any(1)] = True
        logs = np.vstack([np.log(smooth / smooth.sum(0)), np.zeros((1, len(languages)))])
        return cls(languages, logs.astype(np.float32), allowed)

    def label(self, words: Words, n_rows: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and Viterbi language of every word; documents advance side by side, word by word."""
        scores = np.where(self.allowed[words.script], words.sums(self.log_probability), -1e6).astype(np.float32)
        n = np.bincount(words.row, minlength=n_rows)
        by_size = np.argsort(-n, kind="stable")
        first = (np.cumsum(n) - n)[by_size]
        length = n[by_size]
        best = np.zeros((n_rows, len(self.languages)), np.float32)
        stays = np.zeros((len(scores), len(self.languages)), bool)
        came = np.zeros(len(scores), np.int32)
        live = np.searchsorted(-length, -np.arange(1, (length[0] if n_rows else 0) + 1), "right")
        for step, count in enumerate(live):
            now, state = first[:count] + step, best[:count]
            top = state.argmax(1)
            jump = state[np.arange(count), top] - penalty
            stay = state >= jump[:, None]
            stays[now], came[now] = stay, top
            best[:count] = np.where(stay, state, jump[:, None]) + scores[now]
        chosen = np.zeros(len(scores), np.int32)
        state = best.argmax(1)
        for step in range(len(live) - 1, -1, -1):
            count = live[step]
            now = first[:count] + step
            chosen[now] = state[:count]
            state[:count] = np.where(stays[now, state[:count]], state[:count], came[now])
        return scores, chosen


def detect(text: pa.Array, model: Model, penalty: float, with_spans: bool = True) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list]:
    n = len(text)
    words = Words(text)
    k = len(model.languages)
    scores, chosen = model.label(words, n, penalty)
    letters = np.bincount(words.row * k + chosen, weights=words.letters, minlength=n * k).reshape(n, k)
    total = letters.sum(1)
    winner = letters.argmax(1)
    # confidence: share of letters in spans of the winner, by how far its trigrams beat the next language
    own = np.stack([np.bincount(words.row, weights=s, minlength=n) for s in scores.T], axis=1) if k else np.zeros((n, 0))
    per_letter = own / np.maximum(total, 1)[:, None]
    weight = np.exp((per_letter - per_letter.max(1, initial=-np.inf)[:, None]) * 20)
    sure = weight[np.arange(n), winner] / weight.sum(1)
    score = np.where(total > 0, letters[np.arange(n), winner] / np.maximum(total, 1) * (0.5 + sure / 2), 0.0)
    predicted = [model.languages[w] if t else "und" for w, t in zip(winner, total, strict=True)]
    edge = np.ones(len(chosen), bool)
    edge[1:] = (chosen[1:] != chosen[:-1]) | (words.row[1:] != words.row[:-1])
    at = np.flatnonzero(edge)
    n_spans = np.bincount(words.row[at], minlength=n)
    if not with_spans:
        return predicted, score, total.astype(np.int64), n_spans, [None] * n
    size = np.diff(np.r_[at, len(chosen)])
    order = np.arange(len(chosen)) - (np.cumsum(np.bincount(words.row, minlength=n)) - np.bincount(words.row, minlength=n))[words.row]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for i, s in zip(at, size, strict=True):
        spans[words.row[i]].append({"lang": model.languages[chosen[i]], "start": int(order[i]), "words": int(s)})
    return predicted, score, total.astype(np.int64), n_spans, spans


def training_rows(docs: DataFrame, how: Training, held_out: Column) -> DataFrame:
    """``lang, text``: of each language the ``how.max_docs`` different rows with the smallest hashes outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    # one row per language
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    some = known.select("lang", "draw").join(F.broadcast(counts), "lang").where(drawn(F.col("draw"), how.max_docs, F.col("total")))
    chosen = top_per_group(some.select("lang", "draw").distinct(), ["lang"], [F.shiftrightunsigned("draw", 1), F.asc("draw")], how.max_docs)
    # max_docs numbers per language at most
    texts = known.join(F.broadcast(chosen.select("lang", "draw")), ["lang", "draw"])
    return texts.groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")


def feature_counts(rows: DataFrame) -> list:
    """Per language, how often each trigram (``at``) and, above ``NO_GRAM``, the letters of each script occur in ``rows(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, limit=SLICE):
                langs = np.array(part.column(0).to_pylist(), object)
                for language in sorted(set(langs)):
                    words = Words(part.column(1).filter(pa.array(langs == language)))
                    grams = np.bincount(words.grams, minlength=NO_GRAM + 1)[:NO_GRAM]
                    scripts = np.bincount(words.script, weights=words.letters, minlength=len(SCRIPTS) + 2)
                    both = np.concatenate([grams, scripts]).astype(np.int64)
                    at = np.flatnonzero(both)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at])], names=["lang", "at", "n"]
                    )

    sums = rows.mapInArrow(run, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    return sums.groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("sums")).collect()


def identify(docs: DataFrame, how: Training = Training(), parts: int = 4, held: int = 2, with_spans: bool = True) -> DataFrame:
    """Language, confidence and spans of every row of ``docs(doc_id, text, lang)``.

    Learns from text and ``lang`` outside the held-out fold only. Null or empty texts and texts
    without a letter are ``und`` with score 0; with nothing to learn from every row is. Repeated
    rows and null ids are judged row by row, other columns are ignored, an empty table gives an
    empty result. Spans count letter words from 0; without ``with_spans`` they are only counted.
    No shuffle but the bounded training sample and its sums.
    """
    held_out = fold(F.col("doc_id"), parts) == held
    sums = feature_counts(training_rows(docs.select("doc_id", "text", "lang"), how, held_out))
    model = Model.fit(sums, how) if sums else None
    packed = docs.sparkSession.sparkContext.broadcast(model)
    penalty = how.switch_penalty
    # tables of words by languages stay of one size however many languages there are
    limit = SLICE // max(1, -(-len(sums) // 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = packed.value
        for batch in batches:
            for part in A.slices(batch, limit=limit):
                n = part.num_rows
                if learned is None:
                    found = ["und"] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
                else:
                    found = detect(part.column(1), learned, penalty, with_spans)
                span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()),
                     pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64()), pa.array(found[4], pa.list_(span))],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_letters", "n_spans", "spans"],
                )

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def crc_fold(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts
