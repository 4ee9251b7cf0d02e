"""Run queries on Spark and on DuckDB and compare rows, column names and values.

``python tests/oracle.py [sf] [name ...]`` checks the named queries (default: all).
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'").fetchall()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'").fetchall()
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def kind(value):
    return type(value).__name__


def compare(spark_rows, spark_columns, duck_rows, duck_columns):
    """None when equal, else a short text."""
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} vs {sorted(duck_columns)}"
    order = sorted(spark_columns)
    left = [tuple(plain(r[spark_columns.index(c)]) for c in order) for r in spark_rows]
    right = [tuple(plain(r[duck_columns.index(c)]) for c in order) for r in duck_rows]
    if len(left) != len(right):
        note = f"rows {len(left)} vs {len(right)}"
    else:
        note = ""
    a, b = Counter(left), Counter(right)
    if a == b:
        for l, r in zip(sorted(left, key=repr)[:200], sorted(right, key=repr)[:200]):
            if [kind(x) for x in l] != [kind(x) for x in r]:
                return f"types {[kind(x) for x in l]} vs {[kind(x) for x in r]}"
        return None
    only_left, only_right = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{note} {order} spark only ({sum((a - b).values())}): {only_left} duckdb only: {only_right}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"rows {name}: {len(rows)} in {took:.1f}s (no SQL)", flush=True)
            continue
        try:
            start = time.time()
            result = con.execute(sql)
            columns = [d[0] for d in result.description]
            expected = result.fetchall()
            duck = time.time() - start
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: duckdb {str(error)[:800]}", flush=True)
            con = connect(sf_dir)
            continue
        note = compare(rows, df.columns, expected, columns)
        bad += note is not None
        print(f"{'FAIL' if note else 'ok'} {name}: {len(rows)} rows, {took:.1f}s, duckdb {duck:.1f}s {(note or '')[:1200]}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
