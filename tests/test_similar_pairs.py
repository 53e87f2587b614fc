"""Vectors move once per block, not once per pair that is to be compared."""

import numpy as np
import pytest

from trialgauge.operators import search as se


def test_similar_pairs_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[7] = 0.0
    base = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 60, 5)], "query_id long, vec array<double>")
    pairs = [(q, b * 3, 40) for q in range(0, 60, 5) for b in range(60) if (q + b) % 3]
    got = se._similar_pairs(spark.createDataFrame(pairs, "query_id long, id long, candidates long"), base, queries, block_rows=8).collect()
    assert sorted((r["query_id"], r["id"], r["candidates"]) for r in got) == pairs
    for r in got:
        u, v = x[r["query_id"]], x[r["id"] // 3]
        size = np.linalg.norm(u) * np.linalg.norm(v)
        assert r["similarity"] == pytest.approx(u @ v / size if size else 0.0)
