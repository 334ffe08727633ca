"""Run registered queries beside their SQL and report differences.

    python tests/check_queries.py [name ...] [--sf DIR]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, type(x).__name__, x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, rows) of one query against its SQL."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} / {b[:2]}", len(got)
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"{sorted(df.columns)}: {x} != {y}", len(got)
    return None, len(got)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tallyframe.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, fn, oracles[name], args.sf)
            else:
                problem, n = None, len(fn(spark, args.sf).collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s {problem or ''}"[:1500], flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
