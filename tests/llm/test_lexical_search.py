"""Ranked search against scoring every document, and its evaluation against plain sums."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import SF, frame, got, odd_rows
from trialgauge.llm import lexical_search as L

COLUMNS = ("item_id", "rank", "doc_id", "score")


def searched(spark, docs, items, **more):
    table = frame(spark, docs).withColumnsRenamed({"fp": "block", "n_words": "rank", "_id": "score"})
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, score int, _item string")
    return L.search(L.build_index(table), asked, **more)


@pytest.mark.parametrize("which", ["small", "odd", "none"])
def test_search_is_that_of_all_documents(spark, which):
    docs = {
        "small": lambda: [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()],
        "odd": odd_rows, "none": list,
    }[which]()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = " ".join((docs[0][1] if docs else "ab").split()[:6])
    items += [(900, words), (901, f"{words} {words} one TWO"), (902, ""), (903, None), (None, words), (904, "!?"), (905, "one two"), (905, "one two"), (906, "é🙂 zzz")]
    assert got(searched(spark, docs, items), *COLUMNS) == sorted(brute.ranked(docs, items), key=repr)
    assert searched(spark, docs, []).count() == 0


def test_copies_and_ties_end_in_the_smallest_ids(spark):
    rnd = random.Random(3)
    docs = [(i, "alpha beta gamma") for i in range(400)] + [(1000 + i, " ".join(rnd.choice(["alpha", "beta", "rare", "x"]) for _ in range(rnd.randint(1, 9)))) for i in range(200)]
    rnd.shuffle(docs)
    items = [(1, "alpha"), (2, "gamma gamma beta"), (3, "rare alpha"), (4, "unknown"), *((10 + i, "alpha rare") for i in range(300))]
    assert got(searched(spark, docs, items), *COLUMNS) == sorted(brute.ranked(docs, items), key=repr)
    assert got(searched(spark, docs, items[:3], k=3), *COLUMNS) == sorted(brute.ranked(docs, items[:3], 3), key=repr)


def test_a_very_long_document(spark):
    docs = [(1, "word " * 200_000 + "end"), (2, "end"), (3, "word"), (4, "z" * 300_000)]
    items = [(1, "word end"), (2, "z" * 300_000)]
    assert got(searched(spark, docs, items), *COLUMNS) == sorted(brute.ranked(docs, items), key=repr)


def test_hybrid_ranking_equals_plain_sums():
    rnd = np.random.default_rng(6)
    for turn in range(150):
        n, k = int(rnd.integers(1, 300)), int(rnd.integers(1, 12))
        ids = rnd.permutation(n * 2)[:n]
        lists = []
        for _ in range(int(rnd.integers(1, 9))):
            places = np.flatnonzero(rnd.random(n) < rnd.choice([0.01, 0.1, 0.5, 1.0]))
            lists.append((places, rnd.integers(0, 5 if turn % 2 else 10**9, len(places))))
        total = np.zeros(n, np.int64)
        for places, adds in lists:
            total[places] += adds
        want = sorted(((-s, i) for s, i in zip(total.tolist(), ids.tolist()) if s > 0))[:k]
        for short, window in ((1, 7), (10, 64), (10**9, 1024), (0, 16)):
            places, scores = L.rank(lists, ids, k, short, window)
            assert [(-s, i) for s, i in zip(scores.tolist(), ids[places].tolist())] == want
