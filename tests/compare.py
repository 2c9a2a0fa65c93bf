"""Runs queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    from workloads.oracle import ORACLE
    from workloads.queries import QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {lacking}"
    return None if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from workloads.queries import QUERIES

    directory = sys.argv[1]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    bad = 0
    for query in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = compare(session, connection, query, directory)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{query:28} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print("different:", bad)
