"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import numpy as np

import corpus_pipeline
from tests.llm import brute
from trialgauge.llm import near_copies, simhash

SCHEMA = "doc_id bigint, text string, n_chars bigint"


def shingles(text):
    words = brute.NO_BLANK.findall((text or "").translate(brute.LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(rows):
    """The number of the group of every row: those that pairs with a similarity of 0.8 or more join."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                part[root(a)] = root(b)
    return [root(n) for n in range(len(rows))]


def lowest_of_groups(rows):
    low = {}
    for (doc, _), group in zip(rows, grouped(rows), strict=True):
        low[group] = min(low.get(group, doc), doc)
    return sorted(low.values())


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randint(0, 10**9)}"
    return " ".join(out)


def test_one_of_each_group_of_near_copies_is_left(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n", "One two", "one TWO", "one two three"]
    for group in range(60):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(30, 300))]
        texts += [edited(rnd, words, n) for n in (0, len(words) // 60, len(words) // 40, len(words) // 25, len(words) // 8)]
    # more copies than a bucket lists all pairs of
    words = [f"c{i}" for i in range(200)]
    texts += [edited(rnd, words, 2) for _ in range(3 * near_copies.CROWD)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns
    want = lowest_of_groups(rows)
    assert sorted(r["doc_id"] for r in left.collect()) == want
    # the rule of op3 keeps copies that this stage does not
    assert simhash.drop_near_duplicates(docs).count() > len(want)


def groups_of(spark, rows):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA)
    return sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())


def test_a_third_of_all_texts_in_one_bucket_loses_no_group(spark):
    """Texts of one template: many groups of copies with a common half, and a crowd of close copies."""
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(160)]
    texts = []
    for group in range(45):
        own = [f"g{group}x{i}" for i in range(rnd.randint(30, 50))]
        texts += [" ".join(common + own[: len(own) - k]) for k in range(4)]
    texts += [edited(rnd, common, rnd.randint(1, 5)) for _ in range(150)]
    texts += [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(60)) for _ in range(300)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert groups_of(spark, rows) == lowest_of_groups(rows)


def test_crowds_without_a_link_are_left_apart(spark):
    rnd = random.Random(13)
    common = [f"c{i}" for i in range(200)]
    # similarity about 0.7 to each other: they share bands and no link; each has one copy
    texts = [" ".join(common + [f"u{i}x{j}" for j in range(40)]) for i in range(80)]
    texts += [t + " end" for t in texts]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert groups_of(spark, rows) == lowest_of_groups(rows)
    assert len(lowest_of_groups(rows)) == 80


def test_pairs_of_small_buckets_and_members_of_large_ones(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 3)
    entries = spark.createDataFrame([(f, [1, 2 if f < 3 else 10 + f, 20 + f // 3]) for f in range(6)], "fp bigint, bands array<bigint>")
    small, crowd = near_copies.buckets(entries)
    found = {(r["u"], r["v"]) for r in near_copies.small_pairs(small).collect()}
    assert found == {(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)}
    assert {tuple(r) for r in crowd.collect()} == {(1, f, 0) for f in range(6)}


def test_pairs_at_the_least_similarity_are_all_met(spark):
    """Nine shingles, of which eight are common to both: minhash bands missed two such pairs of 20 000, these."""
    texts = []
    for n in (1573, 7903):
        words = [f"k{n}x{i}" for i in range(13)]
        texts += [" ".join(words), " ".join(["new", *words[1:]])]
    rows = list(enumerate(texts))
    assert lowest_of_groups(rows) == [0, 2]
    assert groups_of(spark, rows) == [0, 2]


def test_marks_and_lists_leave_out_no_similar_pair(spark):
    rnd = random.Random(14)
    sets = []
    for _ in range(200):
        base = np.array(rnd.sample(range(1 << 62), rnd.randint(1, 400) + rnd.choice((0, 850))), np.uint64)
        near = base[: len(base) - len(base) // rnd.choice((3, 5, 9, 20))]
        sets += [np.unique(base), np.unique(near)]
    size = np.array([len(s) for s in sets])
    last = np.unique(np.concatenate([s[: len(s) // 7] for s in sets[::2]]))
    lists = near_copies._lists_of(sets, near_copies.listed(size), last).to_pylist()
    flat, words = near_copies.parity_marks(sets, size)
    marks = np.split(flat, np.cumsum(words)[:-1])
    entries = spark.createDataFrame([(n, int(size[n]), m.tolist()) for n, m in enumerate(marks)], "fp bigint, size bigint, mark array<bigint>")
    pairs = spark.createDataFrame([(n, n + 1) for n in range(0, len(sets), 2)], "u bigint, v bigint")
    left = {r["u"] for r in near_copies.possible(pairs, entries).collect()}
    similar = [n for n in range(0, len(sets), 2) if 10 * len(np.intersect1d(sets[n], sets[n + 1])) >= 8 * len(np.union1d(sets[n], sets[n + 1]))]
    assert 100 <= len(similar) <= 190 and left == set(similar)
    assert all(set(lists[n]) & set(lists[n + 1]) for n in similar)
    assert len({len(m) for m in marks}) == 2
