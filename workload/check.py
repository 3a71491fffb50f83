"""Runs registered queries beside their SQL and compares the rows.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from workload.pairs import TABLES
from workload.queries import QUERIES, SQL


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    found = rows(df.columns, df.collect())
    spark_seconds = time.time() - started
    if name not in SQL:
        return True, f"{sum(found.values())} rows, no SQL, {spark_seconds:.1f}s"
    started = time.time()
    result = connection.execute(SQL[name])
    columns = [d[0] for d in result.description]
    expected = rows(columns, result.fetchall())
    note = f"{sum(found.values())} rows, spark {spark_seconds:.1f}s, sql {time.time() - started:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} <> {sorted(columns)}"
    if found != expected:
        return False, f"{note}; only spark {list((found - expected).items())[:3]}; only sql {list((expected - found).items())[:3]}"
    return True, note


def main() -> int:
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duck(sf_dir), []
    for name in sys.argv[2:] or QUERIES:
        try:
            ok, note = compare(spark, connection, sf_dir, name)
        except Exception as error:
            ok, note = False, str(error)[:1500]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        failed += [] if ok else [name]
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
