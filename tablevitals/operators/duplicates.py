"""Rows that repeat an earlier row in every column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.config import BROADCAST_MAX_ROWS
from tablevitals.functions.columns import ROW_INDEX, groupable, is_missing
from tablevitals.operators.batch import Batch
from tablevitals.operators.issues import issue_row, no_issues


def hashed_rows(df: DataFrame, columns: list[str], row_key: str) -> DataFrame:
    """``key``, the values ``v0``, ``v1``, … and their ``hash``; whatever counts as missing is null and equal."""
    values = [F.when(~is_missing(df, c), groupable(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(f"`{row_key}`").alias("key"), *values)
    return rows.withColumn("hash", F.xxhash64(*[f"v{i}" for i in range(len(columns))]))


def repeated_hashes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("hash")


def duplicate_rows(rows: DataFrame, repeated: DataFrame, few: bool) -> DataFrame:
    """Keys (``key``) of all rows but the first of each set of equal rows.

    Only an 8-byte hash per row is shuffled for the whole table. Rows whose
    hash repeats are then compared in full: the first row of every set comes
    from a partial ``min``, and all others are what an anti join on the unique
    row key leaves, so a set of any size is spread over all tasks. ``few`` says
    that the repeated hashes were counted and fit a broadcast.
    """
    small = F.broadcast if few else (lambda df: df)
    candidates = rows.join(small(repeated), "hash", "left_semi")
    values = [c for c in rows.columns if c not in ("key", "hash")]
    firsts = candidates.groupBy(*values).agg(F.min("key").alias("key")).select("key")
    return candidates.select("key").join(small(firsts), "key", "left_anti")


def duplicate(batch: Batch) -> DataFrame:
    if not batch.enabled("duplicate"):
        return no_issues(batch.df.sparkSession)
    columns = [c for c in batch.columns if c != ROW_INDEX]
    rows = hashed_rows(batch.df, columns, batch.row_key)
    repeated = batch.kept(repeated_hashes(rows))
    count = repeated.count()
    if not count:
        return no_issues(batch.df.sparkSession)
    found = duplicate_rows(rows, repeated, count <= BROADCAST_MAX_ROWS)
    return duplicate_issues(found)


def duplicate_issues(found: DataFrame, *keep: str) -> DataFrame:
    """Issues of rows ``key``, behind the columns to keep."""
    return found.select(
        *keep,
        *issue_row(
            "duplicate",
            row_reference=F.col("key"),
            column=F.lit("*"),
            description=F.concat(
                F.lit("Row "), F.col("key").cast("string"), F.lit(" is an exact duplicate of an earlier row in this batch")
            ),
            severity=F.lit("medium"),
            row_index=F.col("key").cast("string"),
        ),
    )
