"""Compare registered queries with their SQL on DuckDB.

    python -m tests.oracle_check --sf 0.01 [name or prefix* ...]
"""

from __future__ import annotations

import argparse
import fnmatch
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from tessera.sources.views import BASE_TABLES

    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(repr(cell(r[i])) for i in order) for r in rows]
    return sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (ok, message, rows, seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sec = time.time() - t0
    if sql is None:
        return True, "rows only", len(got), sec
    rel = con.execute(sql)
    want_cols = [c[0] for c in rel.description]
    want_types = dict(zip(want_cols, [str(c[1]) for c in rel.description]))
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}", len(got), sec
    bad = [
        f"{f.name}:{f.dataType.simpleString()}/{want_types[f.name]}"
        for f in df.schema
        if TYPES.get(f.dataType.simpleString(), "?") != want_types[f.name]
    ]
    if bad:
        return False, f"types {bad}", len(got), sec
    a, b = normal(got, df.columns), normal(want, want_cols)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}", len(got), sec
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} rows differ, first {diff[0]}", len(got), sec
    return True, "match", len(got), sec


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from tessera.session import build_session

    import __spark_entry__ as entry

    spark = build_session(
        "oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not a.names or any(fnmatch.fnmatch(n, pat) for pat in a.names)]
    failed = 0
    for n in names:
        try:
            ok, msg, rows, sec = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg, rows, sec = False, f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        failed += not ok
        flag = "" if rows else "  EMPTY"
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} rows={rows:<7d} {sec:6.2f}s {msg}{flag}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
