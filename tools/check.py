"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

usage: python tools/check.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quizgrove.plans.catalogue import ORACLE, QUERIES  # noqa: E402
from quizgrove.plans.fixtures import BASE  # noqa: E402
from quizgrove.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, name, sf_dir):
    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = frame.collect()
    spark_time = time.time() - start
    if name not in ORACLE:
        return f"rows-only {len(got)}", spark_time, 0.0
    start = time.time()
    cursor = connection.execute(ORACLE[name])
    columns = [item[0] for item in cursor.description]
    expected = cursor.fetchall()
    duck_time = time.time() - start
    if sorted(columns) != sorted(frame.columns):
        return f"FAIL columns {sorted(frame.columns)} != {sorted(columns)}", spark_time, duck_time
    left, right = rows_of(frame.columns, got), rows_of(columns, expected)
    if left != right:
        only_left = [row for row in left if row not in set(right)][:3]
        only_right = [row for row in right if row not in set(left)][:3]
        return f"FAIL {len(left)} vs {len(right)} spark-only {only_left} sql-only {only_right}", spark_time, duck_time
    return f"ok {len(left)}", spark_time, duck_time


def main():
    sf_dir, wanted = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("check", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failures = 0
    for name in QUERIES:
        if wanted and not name.startswith(wanted):
            continue
        try:
            text, spark_time, duck_time = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            text, spark_time, duck_time = f"FAIL {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
        failures += text.startswith("FAIL")
        print(f"{name:32s} {spark_time:6.1f}s {duck_time:6.1f}s  {text}", flush=True)
    print("failures:", failures)


if __name__ == "__main__":
    main()
