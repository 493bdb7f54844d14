"""Compares registered queries with their SQL in DuckDB: ``python tests/oracle.py SF [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime, date)):
        return str(v)
    return v


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as e

    began = time.time()
    df = e.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    cur = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows, {took:.1f} s"
    a, b = set(map(repr, got)), set(map(repr, want))
    return False, f"{len(got)} rows for {len(want)}; only here {sorted(a - b)[:2]}, only SQL {sorted(b - a)[:2]}"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as e

    sf, names = sys.argv[1], sys.argv[2:] or list(e.queries())
    spark, con = session(), duck(f"{DATA}/{sf}")
    bad = 0
    for n in names:
        try:
            ok, say = compare(spark, n, f"{DATA}/{sf}", con)
        except Exception as x:
            ok, say = False, f"{type(x).__name__}: {str(x)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, say, flush=True)
    sys.stdout.flush()
    os._exit(bool(bad))
