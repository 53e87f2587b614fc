"""Distributed operators against brute force, with skew, ties, nulls and copies."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgauge.functions import naming
from trialgauge.functions import text as tx
from trialgauge.operators import anomalies as an
from trialgauge.operators import clustering as clu
from trialgauge.operators import cleaning as cl
from trialgauge.operators import graph as g
from trialgauge.operators import search as se
from trialgauge.operators.components import connected_components
from trialgauge.operators.neighbours import local_outlier_factor, nearest, weighted_vectors
from trialgauge.plans.ordering import exact_quantiles, with_position, with_running_totals
from trialgauge.plans.staging import drop_staged, kept, stage


def skewed(spark, n=3000):
    """A third of the rows share one group and one value."""
    rng = random.Random(3)
    rows = [(f"id{i:05d}", "hot" if i % 3 == 0 else f"g{i % 7}", 1.0 if i % 3 == 0 else float(rng.randint(0, 40))) for i in range(n)]
    return stage(spark.createDataFrame(rows, "id string, grp string, v double"), "skewed"), rows


def test_positions_are_those_of_a_sort(spark):
    df, rows = skewed(spark)
    for within in ([], ["grp"]):
        want = {}
        for key in {r[1] if within else None for r in rows}:
            part = sorted((r[2], r[0]) for r in rows if key is None or r[1] == key)
            want |= {i: (n, len(part)) for n, (_, i) in enumerate(part, 1)}
        got = with_position(df, [F.asc("v"), F.asc("id")], within)
        assert {r["id"]: (r["rank"], r["total"]) for r in got.collect()} == want


def test_running_totals_are_sums_up_to_a_value(spark):
    df, rows = skewed(spark)
    counts = stage(df.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    for r in with_running_totals(counts, [F.asc("v")], ["n"], ["grp"]).collect():
        own = [x[2] for x in rows if x[1] == r["grp"]]
        assert (r["cum_n"], r["all_n"]) == (sum(v <= r["v"] for v in own), len(own))


def test_quantiles_match_numpy(spark):
    df, rows = skewed(spark)
    probs = {"z": 0.0, "a": 0.25, "b": 0.5, "c": 0.95, "o": 1.0}
    for by in (["grp"], []):
        for r in exact_quantiles(df, by, "v", probs).collect():
            v = [x[2] for x in rows if not by or x[1] == r["grp"]]
            assert np.allclose([r[c] for c in probs], np.quantile(v, list(probs.values())))


def test_quantiles_of_tiny_and_of_long_groups(spark):
    rng = random.Random(9)
    rows = [(f"n{n}", rng.choice([rng.random(), float(rng.randint(0, 3))])) for n in range(1, 14) for _ in range(n)]
    rows += [("long", rng.gauss(0, 1)) for _ in range(60_000)] + [(None, 4.0), (None, 5.0), ("none", None)]
    probs = {f"p{i}": p for i, p in enumerate((0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0))}
    df = stage(spark.createDataFrame(rows, "grp string, v double"), "long")
    got = exact_quantiles(df, ["grp"], "v", probs).collect()
    assert {r["grp"] for r in got} == {g for g, v in rows if v is not None}
    for r in got:
        v = [x[1] for x in rows if x[0] == r["grp"] and x[1] is not None]
        assert np.allclose([r[c] for c in probs], np.quantile(v, list(probs.values())))


def cloud(spark, n=400, copies=150):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(n, 3)), np.tile([[0.5, 0.5, 0.5]], (copies, 1))])
    ids = [f"p{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, vec array<double>"), ids, x


def test_nearest_neighbours_are_exact_across_leaves(spark):
    points, _, _ = cloud(spark)
    vectors = stage(weighted_vectors(points), "vectors")
    whole = sorted(map(tuple, nearest(vectors, 6).collect()))
    split = sorted(map(tuple, nearest(vectors, 6, leaf_rows=40).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in split]
    assert np.allclose([r[2] for r in whole], [r[2] for r in split])


def test_outlier_factor_with_copies_matches_brute_force(spark):
    points, ids, x = cloud(spark, 200, 60)
    k = 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    reach = np.maximum(kd[order], np.take_along_axis(d, order, 1))
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    want = dict(zip(ids, lrd[order].mean(axis=1) / lrd))
    got = {r["id"]: r["lof"] for r in local_outlier_factor(points, k, leaf_rows=50).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in ids)


def brute_dbscan(x, eps, need):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = d <= eps
    core = near.sum(axis=1) >= need
    comp = {}
    for i in np.nonzero(core)[0]:
        if i in comp:
            continue
        stack, comp[i] = [i], i
        while stack:
            for j in np.nonzero(near[stack.pop()] & core)[0]:
                if j not in comp:
                    comp[j] = i
                    stack.append(j)
    names = {c: n for n, c in enumerate(sorted(set(comp.values())))}
    out = []
    for i in range(len(x)):
        hits = [j for j in np.nonzero(near[i])[0] if core[j]]
        out.append(names[comp[i]] if core[i] else (names[comp[min(hits)]] if hits else -1))
    return out


@pytest.mark.parametrize("eps,need", [(0.45, 4), (0.8, 3), (0.3, 1)])
def test_dbscan_matches_brute_force(spark, eps, need):
    points, ids, x = cloud(spark, 250, 80)
    got = {r["id"]: r["cluster"] for r in clu.dbscan(points, eps, need).collect()}
    assert [got[i] for i in ids] == brute_dbscan(x, eps, need)


def test_dbscan_joins_components_the_lists_leave_apart(spark):
    """Two dense heaps of distinct points whose closest pair is within eps but on no list."""
    rows = [(f"a{i:03d}", [i * 1e-4, 0.0]) for i in range(60)] + [(f"b{i:03d}", [0.5 + i * 1e-4, 0.0]) for i in range(60)]
    points = spark.createDataFrame(rows, "id string, vec array<double>")
    assert {r["cluster"] for r in clu.dbscan(points, 0.6, 3).collect()} == {0}
    assert {r["cluster"] for r in clu.dbscan(points, 0.3, 3).collect()} == {0, 1}


def test_components_with_a_hub(spark):
    edges = [("hub", f"n{i:03d}") for i in range(200)] + [(f"z{i}", f"z{i + 1}") for i in range(40)]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    got = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "u string, v string")
    )
    found = {r["id"]: r["component"] for r in got.collect()}
    assert {found[n] for n in nodes if n.startswith(("hub", "n"))} == {"hub"}
    assert {found[n] for n in nodes if n.startswith("z")} == {"z0"} and found["alone"] == "alone"


def test_planted_outlier_leads_forest_and_distance(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", [float(a) for a in rng.normal(size=4)]) for i in range(150)] + [("odd", [9.0, -9.0, 9.0, 9.0])]
    points = stage(spark.createDataFrame(rows, "id string, vec array<double>"), "points")
    forest = an.isolation_scores(points, trees=50).orderBy(F.desc("score")).collect()
    assert forest[0]["id"] == "odd" and sum(r["score"] > 0 for r in forest) == pytest.approx(15, abs=2)
    robust = an.robust_distances(points, 4).orderBy(F.desc("distance")).first()
    assert robust["id"] == "odd"
    again = an.isolation_scores(points.repartition(7), trees=50).orderBy(F.desc("score")).first()
    assert again["score"] == forest[0]["score"]


def test_chi_square_helpers():
    assert an.chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-9)
    assert an.chi2_quantile(0.975, 6) == pytest.approx(14.449375, abs=1e-5)


def test_consensus_recovers_agreed_clusters(spark):
    ids = [f"i{n:02d}" for n in range(30)]
    label = lambda f: spark.createDataFrame([(i, f(n)) for n, i in enumerate(ids)], "id string, cluster int")
    runs = [label(lambda n: n // 10), label(lambda n: 2 - n // 10), label(lambda n: (n + (n == 10)) // 10 if n != 10 else 0)]
    got = {r["id"]: r["cluster"] for r in clu.consensus(runs, 3).collect()}
    assert len(set(got.values())) == 3 and all(len({got[i] for i in ids[a : a + 10]}) == 1 for a in (0, 10, 20))


def test_minhash_matches_the_standard_library(spark):
    words = ["Coded Term", "ab", "Site 637", "Pending for Review"]
    got = {r["value"]: list(r["signature"]) for r in se.with_signature(spark.createDataFrame([(w,) for w in words], "value string")).collect()}
    a, b = tx.coefficients()
    for w in words:
        t = w.lower().strip()
        grams = {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t}
        hashes = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in grams]
        assert got[w] == [min((x * h + y) % tx.PRIME for h in hashes) for x, y in zip(a, b)]


def test_edit_similarity_of_empty_texts(spark):
    df = spark.createDataFrame([("", ""), ("ABC", "abd"), ("", "ab")], "x string, y string")
    got = [r[0] for r in df.select(tx.edit_similarity(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([1.0, 2 / 3, 0.0])


def test_ks_matches_brute_force(spark):
    rng = random.Random(4)
    ref, cur = [rng.randint(0, 9) for _ in range(300)], [rng.randint(2, 11) for _ in range(100)]
    rows = [("f", "reference", float(v)) for v in ref] + [("f", "current", float(v)) for v in cur] + [("few", "current", 1.0)]
    got = an.ks_two_sample(spark.createDataFrame(rows, "feature string, side string, value double")).collect()
    want = max(abs(sum(v <= t for v in ref) / 300 - sum(v <= t for v in cur) / 100) for t in range(12))
    assert len(got) == 1 and got[0]["statistic"] == pytest.approx(want) and got[0]["p_value"] < 0.05


def test_graph_first_writer_and_enrichment(spark):
    issues = spark.createDataFrame(
        [("S1 ", "P1", 4, "b"), ("S1", "P1", 9, "a"), (None, "P2", 1, "a")],
        "study string, subject string, total_open_issue_count_per_subject long, row_ord string",
    )
    metrics = spark.createDataFrame([("S1", 13, 1.0, 9, 2.0, 3.0), ("S9", 1, 1.0, 1, 1.0, 1.0)], "study string, total_issues long, avg_issues double, max_issues long, meddra_records double, esae_records double")
    nodes, edges = g.build([g.from_issues(issues)], metrics)
    rows = {r["id"]: r["props"] for r in nodes.collect()}
    assert set(rows) == {"STUDY:S1", "SUBJECT:P1"}
    assert rows["SUBJECT:P1"]["open_issue_count"] == "9" and rows["STUDY:S1"]["total_issues"] == "13.0"
    assert [(r["src"], r["dst"], r["edge_type"]) for r in edges.collect()] == [("SUBJECT:P1", "STUDY:S1", "ENROLLED_IN")]


def test_names():
    assert naming.standard_name(" # Days Outstanding") == "__days_outstanding"
    assert naming.sanitized_name("1st Site (x)") == "col_1st_site_x" and naming.sanitized_name("##") == "unnamed_column"
    assert naming.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_1", "a_1_1", "a_2"]


def test_status_predicates_with_nulls(spark):
    df = spark.createDataFrame([("UnCoded Term",), ("Coded Term",), (None,)], "s string")
    got = df.select(cl.coded(F.col("s")).alias("w"), cl.coded(F.col("s"), "substring").alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (False, False)]


def test_kept_tables_rebuild_when_dropped_or_outdated(spark, tmp_path):
    sources = [str(tmp_path / "in"), str(tmp_path / "other")]
    for path in sources:
        spark.range(3).write.parquet(path)
    calls = []
    build = lambda: (calls.append(1), stage(spark.read.parquet(*sources), "kept"))[1]
    assert kept(spark, "t", sources, build).count() == 6 and kept(spark, "t", sources, build).count() == 6
    assert len(calls) == 1
    drop_staged(spark)
    assert kept(spark, "t", sources, build).count() == 6 and len(calls) == 2
    spark.range(5).write.mode("append").parquet(sources[1])
    assert kept(spark, "t", sources, build).count() == 11 and len(calls) == 3


def test_rewritten_orders_change_the_site_metrics(spark, tmp_path):
    import shutil

    from trialgauge.plans.site_metrics import view_site_metrics

    where = str(tmp_path / "sf")
    # contents only: the originals may be read-only
    os.makedirs(where)
    for name in os.listdir("/root/testdata/sf0.001"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}", f"{where}/{name}")
    before = view_site_metrics(spark, where).agg(F.sum("subject_count")).first()[0]
    orders = f"{where}/orders.parquet"
    one = stage(spark.read.parquet(orders).withColumn("o_custkey", F.lit(1).cast("long")), "orders")
    os.remove(orders)
    one.write.parquet(orders)
    assert view_site_metrics(spark, where).agg(F.sum("subject_count")).first()[0] < before


def test_no_leaf_of_the_neighbour_tree_is_above_the_limit(spark):
    """Ten leaves' worth of vectors, a third of them crowded into one corner."""
    from trialgauge.operators import neighbours as nb

    rng = np.random.default_rng(5)
    limit = 64
    x = rng.normal(size=(10 * limit, 3))
    x[::3] = 5 + rng.normal(size=x[::3].shape) * 1e-4
    rows = [(f"v{i:04d}", [float(c) for c in v], 1) for i, v in enumerate(x)]
    vectors = stage(spark.createDataFrame(rows, "vid string, vec array<double>, weight long"), "v")
    nodes = nb.grow_tree(vectors, limit)
    sizes = nb._placed(vectors, nodes).groupBy("leaf").count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) and max(r["count"] for r in sizes) <= limit
    near = nb.nearest(vectors, 4, limit).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in near:
        assert np.isclose(r["distance"], np.sort(d[int(r["vid"][1:])])[r["rank"] - 1])
    assert len(near) == 5 * len(rows)


def test_set_join_equals_all_pairs(spark, monkeypatch):
    """A few frequent items that a third of the sets share, copies, null items and empty sets."""
    from trialgauge.operators import set_join

    rng = random.Random(1)
    draw = lambda: [f"t{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(rng.randint(0, 14))]
    rows = [(i, ["hot", *draw()] if i % 3 == 0 else draw()) for i in range(300)] + [(300, None), (301, [None]), (302, ["t1", "t1", None]), (303, ["t1"])]
    df = spark.createDataFrame(rows, "id bigint, items array<string>")
    sets = {i: s for i, x in rows if (s := set(x or ()) - {None})}
    alike = lambda a, b, p: 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])
    monkeypatch.setattr(set_join, "TILE", 40)
    for p in (30, 80, 100):
        found = {(r["u"], r["v"]): r["jaccard"] for r in set_join.similar_sets(df, percent=p).collect()}
        assert set(found) == {(a, b) for a in sets for b in sets if a < b and alike(a, b, p)}
        assert all(abs(j - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12 for (a, b), j in found.items())
    few = spark.createDataFrame(rows[:40], "id bigint, items array<string>")
    assert {(r["u"], r["v"]) for r in set_join.similar_sets(few, df, 50).collect()} == {(a, b) for a in sets if a < 40 for b in sets if alike(a, b, 50)}
    assert set_join.similar_sets(df.limit(0)).count() == 0
