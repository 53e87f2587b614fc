"""Small leaves make neither many trips nor large tasks: a vector goes to a block of leaves once."""

import numpy as np

from trialgauge.operators import neighbours as nb


def test_small_leaves_travel_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1500, 6))
    rows = [(f"v{i:04d}", [float(c) for c in v], 1) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vid string, vec array<double>, weight long")
    staged, seen = {}, nb.stage
    monkeypatch.setattr(nb, "stage", lambda df, label="t": staged.setdefault(label, seen(df, label)))
    found = nb.nearest(vectors, 5, leaf_rows=10).collect()
    # about 150 to 300 leaves lie within most bounds here; blocks are at most 40
    assert staged["visits"].count() < 40 * len(x)
    assert staged["visits"].distinct().count() == staged["visits"].count()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, :6]
    got = {}
    for r in found:
        got.setdefault(r["vid"], {})[r["rank"]] = r["distance"]
    assert all(np.allclose([got[f"v{i:04d}"][k] for k in range(1, 7)], want[i]) for i in range(len(x)))


def test_blocks_are_subtrees_of_all_leaves():
    nodes = nb._tree(np.random.default_rng(6).normal(size=(4000, 3)), 400)
    block = nb._blocks(nodes, 10)
    leaves = sum(n[0] < 0 for n in nodes)
    assert len(block) == leaves and set(block) == set(range(block.max() + 1))
    assert np.bincount(block).max() <= 20 and block.max() < 60
    assert (nb._blocks(nodes, nb.LEAF_ROWS) == block.max()).sum() <= 1  # leaves of full size stay alone
