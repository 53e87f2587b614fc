"""Exact vector search meets parts of both sides, copied a bounded number of times."""

import numpy as np

from trialgauge.operators import search as se


def test_copies_do_not_grow_with_the_vectors_while_parts_have_room():
    few, many = (se.parts_of(n, n, 32768, 200, 32) for n in (2_000, 32_000))
    assert max(few) <= 6 and max(many) <= 6 and 32 <= many[0] * many[1]
    assert se.parts_of(1_000_000, 1_000_000, 32768, 200, 32) == (31, 31)
    assert se.parts_of(0, 0, 32768, 200, 32) == (1, 1) and se.parts_of(50, 100_000, 32768, 2048, 32) == (1, 49)


def test_every_vector_finds_the_nearest_with_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(se, "PART_BYTES", 8 * 3 * 40)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-2, 3, size=(150, 3)), np.zeros((3, 3))]).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    base, asked = spark.createDataFrame(rows, "id long, vec array<double>"), spark.createDataFrame(rows, "query_id long, vec array<double>")
    norm = np.linalg.norm(x, axis=1)
    sim = np.divide(x @ x.T, np.outer(norm, norm), out=np.zeros((len(x), len(x))), where=np.outer(norm, norm) > 0)
    got = {}
    for r in se.vector_top_k(base, asked, 5, query_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["similarity"])
    want = {q: sorted(sim[q], reverse=True)[:5] for q in range(len(x))}
    assert all(np.allclose(got[q], want[q], atol=1e-12) for q in want)
    assert [r["id"] for r in se.vector_top_k(base, asked.where("query_id = 152"), 5, query_block=16).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
