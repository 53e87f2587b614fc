"""Clusters joined over long chains: the SQL follows a chain to its end, as the query does."""

import random

import duckdb

from trialgauge.operators import clustering as cl
from trialgauge.plans.staging import stage
from trialgauge.queries.clusters import ORACLES
from trialgauge.queries.sqlkit import oracle


def test_cuts_of_a_long_chain(spark):
    names = [f"Site {i}" for i in range(90)]
    random.Random(5).shuffle(names)
    # one chain of ninety points half a unit apart, broken once by a gap of 1.25
    rows = [(name, [0.5 * i + (0.75 if i >= 60 else 0.0)]) for i, name in enumerate(names)]
    tree = cl.merge_tree(stage(spark.createDataFrame(rows, "id string, vec array<double>"), "chain"))
    got = {(d, r["id"], r["cluster"]) for d in (0.6, 1.0, 1.6) for r in cl.cut_at(tree, d).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE chain(id VARCHAR, x DOUBLE)")
    con.executemany("INSERT INTO chain VALUES (?, ?)", [(n, v[0]) for n, v in rows])
    sql, tables = ORACLES["k04_merge_tree_cuts"]
    pairs = "SELECT a.id AS a, b.id AS b, abs(a.x - b.x) AS d FROM chain a, chain b"
    want = set(con.execute(oracle(sql, **tables, q_pairs=pairs)).fetchall())
    assert len({c for d, _, c in want if d == 0.6}) == 2
    assert got == want
