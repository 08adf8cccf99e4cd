"""Run registered queries against DuckDB over the same tables.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"
TIMES: dict[str, float] = {}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, isinstance(v, str), str(v) if not isinstance(v, (int, float)) else v) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    picked = [tuple(r[i] for i in order) for r in rows]
    return [cols[i] for i in order], sorted(picked, key=_key)


def _same(a, b) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        if type(a) is not type(b):
            return False
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    start = time.time()
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want_cols, want = rows_of(names, rel.fetchall())
    TIMES["sql"] = time.time() - start
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if not all(_same(a, b) for a, b in zip(g, w)):
            return f"row {g} != {w}"
    return None


def main() -> int:
    import __spark_entry__ as e
    from scanmill.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{sf}"
    oracles = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, fn, oracles[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.2f}s {({k: round(v, 2) for k, v in TIMES.items()})} {problem or ''}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
