"""Run registered queries and their SQL counterparts side by side.

usage: python check.py [scale folder] [query name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from evalspark import session
from evalspark.catalog.base import TABLES


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
            return ("", "null")
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return ("b", str(bool(x)))
        if isinstance(x, int) or type(x).__name__.startswith(("int", "uint")):
            return ("i", str(int(x)))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return ("f", repr(float(x)))
        return ("s", str(x))

    return sorted(tuple(cell(x) for x in row) for row in frame.astype(object).itertuples(index=False, name=None))


def compare(spark_rows: list[tuple], duck_rows: list[tuple]) -> str:
    if len(spark_rows) != len(duck_rows):
        return f"ROWS {len(spark_rows)} vs {len(duck_rows)}"
    if spark_rows == duck_rows:
        return "ok"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows, strict=True) if a != b]
    return f"DIFF {len(bad)} of {len(spark_rows)}: {bad[0][0]} vs {bad[0][1]}"


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    from evalspark.catalog import REGISTRY

    names = args or list(REGISTRY)
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        session.builder("check").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    failures = 0
    for name in names:
        q = REGISTRY[name]
        try:
            start = time.time()
            mine = q(spark, folder).toPandas()
            took = time.time() - start
            if q.oracle is None:
                print(f"{name:32s} rows-only {len(mine):8d} rows {took:6.2f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(q.oracle).df()
            duck = time.time() - start
            if sorted(mine.columns) != sorted(theirs.columns):
                verdict = f"COLUMNS {sorted(mine.columns)} vs {sorted(theirs.columns)}"
            else:
                verdict = compare(canonical(mine), canonical(theirs))
        except Exception as error:
            verdict, mine, took, duck = f"ERROR {str(error)[:600]}", [], 0.0, 0.0
        failures += verdict != "ok"
        print(f"{name:32s} {len(mine):8d} rows {took:6.2f}s duck {duck:5.2f}s {verdict}", flush=True)
    print("failures", failures)
    spark.stop()
    return failures


if __name__ == "__main__":
    sys.exit(main())
