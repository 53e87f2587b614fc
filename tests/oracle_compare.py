"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6g}" if abs(v) >= 1e6 else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "hugeint": "int", "integer": "int", "ubigint": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
}


def kind(name: str) -> str:
    name = name.lower()
    return "decimal" if name.startswith("decimal") else KIND.get(name, name)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    mine = {c: kind(t) for c, t in df.dtypes}
    off = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
    if got != want:
        only_g = [r for r in got if r not in set(want)][:2]
        only_w = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}; spark-only {only_g}; sql-only {only_w}"
    if off:
        return False, f"types differ: {off}"
    return True, f"{len(got)} rows"
