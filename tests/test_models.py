"""Model operators against brute force and their invariants, with planted strangers and copies."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgauge.operators import anomalies as an
from trialgauge.operators import clustering as clu
from trialgauge.operators import graph as g
from trialgauge.operators import search as se
from trialgauge.plans.staging import stage


def frame(spark, x):
    return stage(spark.createDataFrame([(f"p{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, vec array<double>"), "points")


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups, copies of one point, and a stranger, the last."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.3 + c for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0))] + [np.zeros((10, 3)), [[40.0, 40.0, 40.0]]])
    return frame(spark, x), x


def test_forest_and_robust_distance_find_a_stranger(blobs):
    points, x = blobs
    stranger = f"p{len(x) - 1:04d}"
    forest = an.isolation_scores(points, trees=50)
    rows = {r["id"]: r["score"] for r in forest.collect()}
    assert max(rows, key=rows.get) == stranger and 0 < sum(s > 0 for s in rows.values()) <= 0.1 * len(rows) + 1
    far = {r["id"]: r["distance"] for r in an.robust_distances(points, 3).collect()}
    assert min(far.values()) >= 0 and far[stranger] > 10 * max(v for k, v in far.items() if k != stranger)
    # trees do not depend on how the rows lie
    again = an.isolation_scores(points.repartition(7), trees=50)
    assert {r["id"]: r["score"] for r in again.collect()} == rows


def test_forest_samples_are_the_smallest_digests(spark):
    x = np.random.default_rng(3).normal(size=(700, 2))
    model, size = an.fit_isolation_forest(frame(spark, x), trees=4, subsample=64)
    assert size == 64 and len(model) == 4 and all(len(t) <= 2 * 64 for t in model)


def test_robust_fit_has_the_least_determinant_of_many_starts(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(75, 2)), rng.normal(size=(25, 2)) * 0.1 + 9])
    live, mean, _ = an.fit_robust(frame(spark, x), 2)
    assert live == [0, 1] and np.abs(mean).max() < 1
    h = (len(x) + 3) // 2
    own = min((an._concentrate(x, rng.choice(len(x), 3, replace=False), h, 100) for _ in range(200)), key=lambda r: r[0])
    best = an._starts(frame(spark, x), len(x), 2, 100, 42)[0]
    assert np.linalg.slogdet(best[1])[1] <= own[0] + 0.02


def test_exact_drift_tail_is_that_of_all_orders():
    for m, n in itertools.product(range(1, 7), range(1, 9)):
        gaps = []
        for own in itertools.combinations(range(m + n), m):
            i = j = gap = 0
            for t in range(m + n):
                i, j = (i + 1, j) if t in own else (i, j + 1)
                gap = max(gap, abs(i * n - j * m))
            gaps.append(gap)
        for d in {0, *gaps, m * n + 1}:
            assert abs(an.exact_tail(d, m, n) - sum(x >= d for x in gaps) / len(gaps)) < 1e-12


def test_clusters_are_near_their_centre_and_probabilities_sum_to_one(blobs):
    points, x = blobs
    labels = stage(clu.kmeans(points, 4), "labels")
    assert clu.labelled_once(points, labels, 4).where("not ok").count() == 0
    assert clu.nearest_to_own_centre(points, labels).where("not ok").count() == 0
    for r in clu.gaussian_mixture(points.where("id < 'p0130'"), 3, 2).collect():
        assert abs(sum(r["probabilities"]) - 1) < 1e-6 and r["probabilities"][r["cluster"]] == max(r["probabilities"])
    for labels in (clu.bisecting(points, 3), clu.spectral(points.where("id < 'p0130'"), 3)):
        labels = stage(labels, "labels")
        assert clu.labelled_once(labels, labels, 3).where("not ok").count() == 0


def single_linkage(x, height=None, k=None):
    part = list(range(len(x)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = sorted((d[a, b], a, b) for a in range(len(x)) for b in range(a))
    left = len(x)
    for w, a, b in pairs:
        if (height is not None and w > height) or (k is not None and left <= k):
            break
        if part[a] != part[b]:
            old, new = part[a], part[b]
            part = [new if p == old else p for p in part]
            left -= 1
    return {frozenset(i for i in range(len(x)) if part[i] == p) for p in set(part)}


@pytest.mark.parametrize("leaf_rows", [16, 4096])
def test_one_merge_tree_answers_every_cut(spark, leaf_rows):
    rng = np.random.default_rng(5)
    # groups larger than a neighbour list, far apart, and copies
    x = np.concatenate([rng.normal(size=(25, 2)) * 0.2 + c for c in ((0, 0), (3, 0), (0, 30), (100, 100))] + [np.full((6, 2), 50.0)])
    tree = clu.merge_tree(frame(spark, x), leaf_rows)
    of = lambda df: {frozenset(int(i[1:]) for i in r["ids"]) for r in df.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()}
    assert tree[1].count() == len(np.unique(x, axis=0)) - 1
    for height in (0.0, 0.25, 2.9, 40.0, 500.0):
        assert of(clu.cut_at(tree, height)) == single_linkage(x, height=height)
    for k in (1, 3, 5):
        assert of(clu.cut_into(tree, k)) == single_linkage(x, k=k)


def test_questions_at_once_are_the_single_runs(spark):
    nodes, edges = (stage(df, "g") for df in g.build_from_views(spark, "/root/testdata/sf0.001"))
    index, links = stage(g.keyword_index(nodes), "index"), g.adjacency(edges)
    texts = ["pending visit of subject 12 at site 7", "safety review Pending", "Study 2 country", "unheard words", "SITE site Site"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    start = stage(g.retrieve_many(index, asked, 5), "start")
    many = g.helpful_many(g.expand_many(nodes, links, asked, start, n_hops=2, beam=6)).collect()
    for qid, text in enumerate(texts):
        one = g.keyword_retrieve(index, text, 5)
        seen = g.helpfulness(g.beam_expand(nodes, edges, text, one, n_hops=2, beam=6))
        want = {(r["id"], r["hop"], round(r["similarity"], 9), round(r["helpfulness"], 9)) for r in seen.collect()}
        assert {(r["id"], r["hop"], round(r["similarity"], 9), round(r["helpfulness"], 9)) for r in many if r["qid"] == qid} == want
        assert sum(r["kept"] for r in many if r["qid"] == qid) == g.prune(seen).count()


def test_hops_do_not_move_the_adjacency(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 500}", "E") for i in range(500)], "src string, dst string, edge_type string")
    links = g.adjacency(edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.createDataFrame([("n1",), ("n2",)], "node string")
        plan = links.join(front, "node")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount" in plan and plan.count("Exchange hashpartitioning") == 1


def test_bucketed_search_finds_close_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(20, 16)) * 0.2 for c in centres])
    base = stage(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>"), "base")
    asked = base.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    exact = {(r["query_id"], r["id"]) for r in se.vector_top_k(base, asked, 5).collect()}
    rows = se.bucketed_top_k(base, asked, 5, tables=4, probes=2).collect()
    assert len(exact & {(r["query_id"], r["id"]) for r in rows}) >= 0.9 * len(exact)
    assert np.mean([r["candidates"] for r in rows]) < 0.1 * len(x)
    assert all(1 <= r["rank"] <= 5 for r in rows)


def test_similar_values_are_all_pairs(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(120)] + ["", " ", "AB", "ab"]
    values, keywords = words[:90], words[60:]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t}
    want = {(k, v) for k in keywords for v in values if 2 * len(grams(k.lower().strip()) & grams(v.lower().strip())) >= len(grams(k.lower().strip()) | grams(v.lower().strip()))}
    got = se.similar_values(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(k,) for k in keywords], "keyword string"), 50)
    assert {(r["keyword"], r["value"]) for r in got.collect()} == want


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_edit_join_is_all_pairs(spark, edits):
    rnd = random.Random(edits)
    words = ["".join(rnd.choice("abB") for _ in range(rnd.randint(0, 9))) for _ in range(80)] + ["common prefix 1", "common prefix 23", "Common Prefix 4"]
    values, keywords = words[:60] + words[-2:], words[40:]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(k, v, d) for k in keywords for v in values if (d := distance(k.lower(), v.lower())) <= edits}
    rows = lambda c, x: spark.createDataFrame([(w,) for w in [*x, None]], f"{c} string")
    assert {tuple(r) for r in se.edit_join(rows("value", values), rows("keyword", keywords), edits).collect()} == want
