"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Features of the line and of its neighbours give its evidence, two
states and their transitions tie neighbouring lines together, and forward-backward gives the
marginal chance that each line is good. Marginals weighted by line length are a document's
raw score, which a logistic curve fitted on the training documents turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import drawn, top_per_group
from ..plans.staging import stage
from . import arrays as A
from .language import fold

THRESHOLD = 0.3
SLICE = 2 << 20
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_lines bigint, n_bad_lines bigint"

LETTER = A.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
UPPER = A.byte_class((0x41, 0x5A))
LOWER = A.byte_class((0x61, 0x7A))
DIGIT = A.byte_class((0x30, 0x39))
SPACE = A.byte_class((0x20, 0x20), (0x09, 0x0D))
SENTENCE = A.byte_class(*((c, c) for c in b".,;:?!"))
MARK = ~(LETTER | DIGIT | SPACE | SENTENCE)
PIPE = A.byte_class((0x7C, 0x7C))
BANG = A.byte_class((0x21, 0x21))
CLASSES = (LETTER, UPPER, LOWER, DIGIT, SENTENCE, MARK, PIPE, BANG)


@dataclass(frozen=True)
class Training:
    """The documented bound of the training sample: of each quality ``max_docs`` labelled documents, those with the
    smallest hash of their id, taken as whole texts while they hold ``max_chars`` characters together; a
    document that would pass that bound is left out, but each quality keeps its shortest one. A
    quality with more labels than were drawn weighs as many. ``decay`` is the weight of the
    squared parameters, ``steps`` and ``rate`` those of the gradient method."""

    max_docs: int = 2000
    max_chars: int = 16_000_000
    decay: float = 1e-3
    steps: int = 150
    rate: float = 0.1


class Lines:
    """Lines of a slice of documents: their document, weight, and features."""

    def __init__(self, text: pa.Array) -> None:
        raw, offs = A.utf8(text)
        n = len(text)
        newline = np.flatnonzero(raw == 0x0A)
        # a document has one line more than it has newlines, so that an empty one has an empty line
        per_doc = np.diff(np.searchsorted(newline, offs)) + 1
        self.count = per_doc
        self.first = np.cumsum(per_doc) - per_doc
        self.row = np.repeat(np.arange(n), per_doc)
        starts = np.zeros(len(self.row), np.int64)
        ends = np.zeros(len(self.row), np.int64)
        starts[self.first] = offs[:-1]
        ends[self.first + per_doc - 1] = offs[1:]
        inner = np.ones(len(self.row), bool)
        inner[self.first] = False
        starts[inner] = newline + 1
        outer = np.ones(len(self.row), bool)
        outer[self.first + per_doc - 1] = False
        ends[outer] = newline
        self.length = ends - starts
        own = self._own(raw, offs, starts, ends)
        zero = np.zeros((1, own.shape[1]), np.float32)
        before = np.vstack([zero, own[:-1]])
        after = np.vstack([own[1:], zero])
        before[self.first] = 0
        after[self.first + per_doc - 1] = 0
        edge = np.zeros((len(own), 2), np.float32)
        edge[self.first, 0] = 1
        edge[self.first + per_doc - 1, 1] = 1
        self.features = np.hstack([own, before, after, edge])

    def _own(self, raw: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = np.maximum(self.length, 1)
        n = len(starts)
        at, lengths, _ = A.words(raw, offs, A.NOT_SPACE)
        line = np.searchsorted(starts, at, "right") - 1
        hashes = A.piece_hashes(A.lower_ascii(raw), at, lengths)
        words = np.bincount(line, minlength=n)
        some = np.maximum(words, 1)
        shares = [A.range_sums(table[raw], starts, ends) / size for table in CLASSES]
        echo = np.zeros(len(at))
        if len(at) > 1:
            echo[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        marked = MARK[raw] | BANG[raw]
        noisy = A.range_sums(marked, at, at + lengths) >= 2
        key = A.mix(hashes + A.mix(line.astype(A.U64)))
        distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=n)
        whole = A.piece_hashes(raw, starts, self.length)
        mixed = A.mix(whole + A.mix(self.row.astype(A.U64)))
        _, group, times = np.unique(mixed, return_inverse=True, return_counts=True)
        log_words = np.log1p(words)
        columns = [
            *shares,
            np.bincount(line, weights=echo, minlength=n) / some,
            np.bincount(line, weights=noisy, minlength=n) / some,
            distinct / some,
            np.bincount(line, weights=lengths, minlength=n) / some / 10,
            np.bincount(line, weights=lengths > 25, minlength=n) / some,
            np.minimum(log_words, 6) / 6,
            words < 3,
            words == 0,
            (times[group] > 1) & (words > 0),
            np.log1p(self.count[self.row]) / 5,
        ]
        return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


@dataclass
class Field:
    """Weights of the evidence for good, transition scores [from bad/good, to bad/good], logistic curve."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, lines: Lines) -> np.ndarray:
        return (lines.features @ self.weights + self.bias).astype(np.float64)


def marginals(evidence: np.ndarray, count: np.ndarray, moves: np.ndarray, by_line: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for every line, and expected transitions, each weighted ``by_line``; documents advance side by side.

    ``evidence`` is the score of good against bad; documents follow one another with ``count``
    lines each, at least one.
    """
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    size = count[order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    score = np.stack([np.zeros(len(evidence)), evidence], axis=1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    for step, n in enumerate(live):
        now = first[:n] + step
        if step:
            forward[now] = score[now] + np.logaddexp(forward[now - 1, :1] + moves[0], forward[now - 1, 1:] + moves[1])
        else:
            forward[now] = score[now]
    for step in range(len(live) - 2, -1, -1):
        now = first[: live[step + 1]] + step
        ahead = score[now + 1] + backward[now + 1]
        backward[now] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(evidence), bool)
    inner[np.cumsum(count) - count] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + moves[None] + (score[at] + backward[at])[:, None, :]
    each = np.exp(pair - total[at][:, None, None])
    expected = each.sum(0) if by_line is None else np.tensordot(by_line[at], each, 1)
    return good, expected


def raw_scores(lines: Lines, good: np.ndarray) -> np.ndarray:
    """Marginals weighted by line length; a document of empty lines weighs them alike."""
    weight = lines.length.astype(float)
    total = np.bincount(lines.row, weights=weight)
    weight = np.where(total[lines.row] > 0, weight, 1.0)
    return np.bincount(lines.row, weights=weight * good) / np.bincount(lines.row, weights=weight)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: list[str], quality: np.ndarray, how: Training = Training(), weight: np.ndarray | None = None) -> Field:
    """Conditional likelihood of the lines' labels, which are those of their document; ``weight`` says for how many documents one stands."""
    lines = Lines(pa.array(texts, pa.large_string()))
    weight = np.ones(len(texts)) if weight is None else weight / weight.mean()
    x = lines.features.astype(np.float64)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    truth = quality[lines.row].astype(float)
    inner = np.ones(len(truth), bool)
    inner[lines.first] = False
    at = np.flatnonzero(inner)
    by_line = weight[lines.row]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[at - 1].astype(int), truth[at].astype(int)), by_line[at])
    theta = np.zeros(x.shape[1] + 4)
    descent = _Adam(len(theta), how.rate)
    n = len(texts)
    for _ in range(how.steps):
        moves = theta[-4:].reshape(2, 2)
        good, expected = marginals(x @ theta[:-4], lines.count, moves, by_line)
        gradient = np.r_[x.T @ ((good - truth) * by_line), (expected - seen).ravel()] / n + how.decay * theta
        theta -= descent.step(gradient)
    weights = theta[:-5] / spread
    field = Field(weights.astype(np.float32), float(theta[-5] - mean @ weights), theta[-4:].reshape(2, 2))
    good, _ = marginals(field.evidence(lines), lines.count, field.moves)
    z = _logit(raw_scores(lines, good))
    curve, descent = np.array([0.5, 0.0]), _Adam(2, 0.05)
    for _ in range(400):
        p = 1 / (1 + np.exp(-(curve[0] * z + curve[1])))
        curve -= descent.step(np.array([(weight * (p - quality) * z).mean(), (weight * (p - quality)).mean()]) + 1e-4 * curve)
    field.slope, field.shift = max(float(curve[0]), 1e-3), float(curve[1])
    return field


def score(text: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, Lines]:
    lines = Lines(text)
    good, _ = marginals(field.evidence(lines), lines.count, field.moves)
    z = _logit(raw_scores(lines, good))
    return 1 / (1 + np.exp(-(field.slope * z + field.shift))), good, lines


def within_bound(rows: list, limit: int) -> list:
    """Rows in their order while their ``size`` adds up to ``limit`` at most, and the shortest of each quality."""
    kept, total = {min((r for r in rows if r["quality"] == q), key=lambda r: r["size"]) for q in {r["quality"] for r in rows}}, 0
    total = sum(r["size"] for r in kept)
    for r in rows:
        if r not in kept and total + r["size"] <= limit:
            kept.add(r)
            total += r["size"]
    return [r for r in rows if r in kept]


def training_sample(docs: DataFrame, labels: DataFrame, how: Training, held_out: Column) -> tuple[list, np.ndarray]:
    """Labels outside the held-out fold with the whole text of their document, within the bounds of ``how``, and for how
    many labels each stands; of several rows with one id the smallest text."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("draw"))
    counts = {r["quality"]: r["total"] for r in chosen.groupBy("quality").agg(F.count(F.lit(1)).alias("total")).collect()}
    if not counts:
        return [], np.zeros(0)
    wanted = F.when(F.lit(False), F.lit(True))
    for quality, total in counts.items():
        wanted = wanted.when(F.col("quality") == quality, drawn(F.col("draw"), how.max_docs, total))
    some = chosen.where(wanted).distinct()
    some = top_per_group(some, ["quality"], [F.shiftrightunsigned("draw", 1), F.asc("doc_id")], how.max_docs).select("doc_id", "quality", "draw")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the other side has two numbers for each of 2 * max_docs rows at most
    texts = stage(texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "draw").agg(F.min("text").alias("text")), "sample")
    sizes = sorted(texts.select("doc_id", "quality", "draw", F.length("text").alias("size")).collect(), key=lambda r: (r["draw"] % (1 << 64), r["doc_id"], r["quality"]))
    kept = within_bound(sizes, how.max_chars)
    keys = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in kept], "doc_id long, quality int") if kept else None
    rows = texts.join(F.broadcast(keys), ["doc_id", "quality"]).collect() if kept else []
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    drawn_of = {q: sum(r["quality"] == q for r in rows) for q in counts}
    return rows, np.array([counts[r["quality"]] / drawn_of[r["quality"]] for r in rows])


def line_quality(docs: DataFrame, labels: DataFrame, how: Training = Training(), parts: int = 5, held: int = 0) -> DataFrame:
    """Quality score of every row of ``docs(doc_id, text)``, learned from ``labels(doc_id, quality)``.

    Labels of the held-out fold, null ones and those other than 0 and 1 are not learned from;
    without any to learn from every score is 0.5. Null and empty texts are one empty line and
    scored. Repeated rows and null ids are scored row by row, other columns are ignored, an
    empty table gives an empty result. Only the bounded training sample is shuffled or gathered.
    """
    held_out = fold(F.col("doc_id"), parts) == held
    sample, weight = training_sample(docs, labels, how, held_out)
    field = fit([r["text"] for r in sample], np.array([r["quality"] for r in sample]), how, weight) if sample else None
    packed = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = packed.value
        for batch in batches:
            for part in A.slices(batch, limit=SLICE):
                n = part.num_rows
                if learned is None:
                    p, bad, count = np.full(n, 0.5), np.zeros(n, np.int64), np.zeros(n, np.int64)
                else:
                    p, good, lines = score(part.column(1), learned)
                    bad, count = np.bincount(lines.row[good < 0.5], minlength=n), lines.count
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32)),
                     pa.array(count, pa.int64()), pa.array(bad, pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, SCHEMA)
