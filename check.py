"""Run workloads against their SQL: python check.py [--sf 0.01] [name-prefix ...]"""

from __future__ import annotations

import argparse
import atexit
import math
import shutil
import sys
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import DataFrame

from cinelake.session import build_session
from workloads import load
from workloads.views import TABLES

DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows_of(df: DataFrame):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def compare(df: DataFrame, con, sql: str) -> tuple[str, int]:
    names, got = rows_of(df)
    res = con.execute(sql)
    duck_names = [d[0] for d in res.description]
    duck_types = {d[0]: str(d[1]) for d in res.description}
    want_raw = res.fetchall()
    order = [duck_names.index(n) for n in sorted(duck_names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in want_raw), key=repr)
    if names != sorted(duck_names):
        return f"columns {names} != {sorted(duck_names)}", len(got)
    for n, t in df.dtypes:
        expected = DUCK_TYPES.get(t)
        if expected is None or duck_types[n].upper() not in (expected, {"VARCHAR": "STRING", "DOUBLE": "NUMBER"}.get(expected, "")):
            if expected is None or expected != duck_types[n].upper():
                return f"type of {n}: {t} vs {duck_types[n]}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"first difference: {a} != {b}"[:1500], len(got)
    return "ok", len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--root", default="/root/testdata")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{args.root}/sf{args.sf}"
    queries, oracles = load()
    shared = tempfile.mkdtemp(prefix="spark-")  # one machine: any folder is shared
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__checkpoint__dir=shared, spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                verdict, n = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                verdict = "ok (rows only)"
        except Exception as exc:  # report and go on with the next one
            verdict, n = f"FAILED {type(exc).__name__}: {str(exc)[:400]}", -1
            if args.names:
                print(traceback.format_exc(limit=-6)[-1500:] if "Analysis" not in type(exc).__name__ else "".join(traceback.format_tb(exc.__traceback__)[-8:-4]))
        if not verdict.startswith("ok"):
            bad += 1
        print(f"{name:40s} {time.time() - t0:6.2f}s {n:7d}  {verdict}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
