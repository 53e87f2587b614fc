"""Sequence models against enumeration of all labelings, and what the training samples hold."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialgauge.llm import language, quality_crf


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        count = rng.integers(1, 6, rng.integers(1, 5))
        evidence, moves = rng.normal(size=count.sum()) * 2, rng.normal(size=(2, 2))
        by_line = np.repeat(rng.random(len(count)) + 0.5, count)
        good, expected = quality_crf.marginals(evidence, count, moves, by_line)
        want_good, want_moves, at = np.zeros(count.sum()), np.zeros((2, 2)), 0
        for n in count:
            weights = {}
            for labels in itertools.product((0, 1), repeat=int(n)):
                score = sum(evidence[at + i] for i in range(n) if labels[i]) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))
                weights[labels] = np.exp(score)
            total = sum(weights.values())
            for labels, w in weights.items():
                for i, x in enumerate(labels):
                    want_good[at + i] += x * w / total
                for a, b in zip(labels, labels[1:]):
                    want_moves[a, b] += w / total * by_line[at]
            at += n
        assert np.allclose(good, want_good) and np.allclose(expected, want_moves)


@pytest.mark.parametrize("languages", [3, 200])
def test_word_languages_are_the_best_of_all_labelings(languages):
    rng = np.random.default_rng(languages)
    names = [f"l{i:03d}" for i in range(languages)]
    table = np.vstack([rng.normal(size=(language.NO_GRAM, languages)), np.zeros((1, languages))]).astype(np.float32)
    allowed = rng.random((len(language.SCRIPTS) + 2, languages)) < 0.8
    allowed[:, 0] = True
    model = language.Model(names, table, allowed)
    text = pa.array(["ab cde fg", "", "один ab два", "x", None, "aa bb cc dd"])
    words = language.Words(text)
    penalty = 3.0
    scores, chosen = model.label(words, len(text), penalty)
    for row in range(len(text)):
        own = np.flatnonzero(words.row == row)
        some = range(languages) if languages < 10 else sorted({0, *chosen[own].tolist(), *rng.integers(0, languages, 3).tolist()})
        worth = lambda labels: sum(float(scores[w, x]) for w, x in zip(own, labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))
        best = max((worth(labels) for labels in itertools.product(some, repeat=len(own))), default=0)
        assert np.isclose(worth(chosen[own].tolist()), best, atol=1e-3)
        assert all(allowed[words.script[w], x] for w, x in zip(own, chosen[own]))


def made(letters, n, rnd):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(n))


def test_a_rare_language_is_learned_and_long_texts_count_whole(spark):
    rnd = random.Random(3)
    rows = [(i, made("abcdefg" if i % 2 else "hijklmn", 6, rnd), "one" if i % 2 else "two", None) for i in range(3000)]
    # repeated rows are one of the sample
    rows += [(8, rows[8][1], "two", None)] * 1500
    rare = [i for i in range(5000, 5200) if language.crc_fold(i, 4) != 2][:5] + [i for i in range(5000, 5200) if language.crc_fold(i, 4) == 2][:2]
    rows += [(i, made("opqrstu", 6, rnd), "rare", None) for i in rare]
    # a language whose Latin letters come after 6000 Greek ones
    late = [i for i in range(6000, 6200) if language.crc_fold(i, 4) != 2][:4]
    rows += [(i, made("αβγδεζη", 1000, rnd) + " " + made("vwxyz", 3000, rnd), "late", None) for i in late]
    rows += [(7000, made("vwxyz", 9, rnd), None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, draw int")
    how = language.Training(max_docs=50)
    sample = language.training_rows(docs, how, language.fold(F.col("doc_id"), 4) == 2).groupBy("lang").count().collect()
    assert dict(map(tuple, sample)) == {"one": 50, "two": 50, "rare": 5, "late": 4}
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, how, with_spans=False).collect()}
    assert all(told[i] == "rare" for i in rare) and told[7000] == "late"
    assert all(told[i] == ("one" if i % 2 else "two") for i in range(3000))


def test_quality_sample_holds_both_labels_and_whole_texts(spark):
    rnd = random.Random(5)
    rows = [(i, made("abcdefg", 30, rnd) + ".", "x") for i in range(2000)] + [(2000 + i, "|||| " * 40, "x") for i in range(3)]
    # the junk of a long document comes after 30 000 characters
    rows += [(2100, made("abcdefg", 6000, rnd) + "\n" + "\n".join("#### %% |" for _ in range(4000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, 1 if i < 2000 else 0) for i, _, _ in rows] * 2 + [(None, 1), (1, None), (2, 7)], "doc_id bigint, quality int")
    how = quality_crf.Training(max_docs=100)
    sample, weight = quality_crf.training_sample(docs, labels, how, F.lit(False))
    assert sum(r["quality"] for r in sample) == 100 and len(sample) == 104
    assert {len(r["text"]) for r in sample if r["doc_id"] == 2100} == {len(rows[-1][1])}
    assert weight[[r["quality"] == 1 for r in sample]].sum() > 900 * weight[[r["quality"] == 0 for r in sample]].sum() / 4
    small, _ = quality_crf.training_sample(docs, labels, quality_crf.Training(max_docs=100, max_chars=9000), F.lit(False))
    assert {r["quality"] for r in small} == {0, 1} and sum(len(r["text"]) for r in small) <= 9000
    scores = {r["doc_id"]: r["score"] for r in quality_crf.line_quality(docs, labels, how).collect()}
    assert max(scores[i] for i in range(2000, 2003)) < 0.3 < min(scores[i] for i in range(2000))
