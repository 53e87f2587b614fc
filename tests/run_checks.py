"""Developer tool: compare registered queries with their SQL.

    python tests/run_checks.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.oracle_compare import compare, connect  # noqa: E402
from trialgauge.session import local_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "sf0.01"
    prefixes = tuple(args[1:]) or ("",)
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                ok, note = compare(df, con, sql[name])
            else:
                rows = df.collect()
                ok, note = len(rows) > 0, f"{len(rows)} rows, no SQL; first {str(rows[:1])[:160]}"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - began:6.2f}s {name}: {note}", flush=True)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
