"""Compare registered queries with their SQL in DuckDB: python tests/check.py [-d FOLDER] [name ...]"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from tickertide.session import build_session  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        return float(v) if isinstance(v, float) else v

    return sorted((tuple(plain(rec[k]) for k in order) for rec in records), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = entry_module.queries()[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL)"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    note = f"rows={len(got)}/{len(want)} spark={took:.1f}s duck={time.time() - start:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, note
    bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{note} first differences: {bad}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.d)
    failed = 0
    for name in entry_module.queries():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            ok, note = compare(spark, con, name, args.d)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
