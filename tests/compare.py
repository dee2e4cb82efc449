"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal (or nothing to compare with), else a message."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} of {len(want[1])} rows differ, e.g. {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    queries, oracle = e.queries(), e.oracle_sql()
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            message = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            message = traceback.format_exc()[-1500:] if args else str(error)[:400]
        bad += message is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {name:22s} {kind} {time.time()-start:6.2f}s {message or ''}", flush=True)
    print("failures:", bad)
