"""Missing values per column, and entities absent from a period."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import BROADCAST_MAX_ROWS
from tablevitals.functions.columns import as_text, is_missing, long_form
from tablevitals.functions.pyformat import fixed_text
from tablevitals.operators.batch import Batch
from tablevitals.operators.issues import issue_row, no_issues

PERIODS_PER_CHUNK = 512


def completeness(batch: Batch) -> DataFrame:
    """Columns with a share of missing cells strictly above the threshold.

    One aggregation, reshaped to a row per column.
    """
    df, spark = batch.df, batch.df.sparkSession
    if not batch.enabled("completeness") or not batch.columns:
        return no_issues(spark)
    threshold = batch.params("completeness").get("null_pct_threshold", 20.0)
    # Alone, the rule's plan keeps only the missing counts of the stats pass.
    counted = batch.stats_table()
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit(i).alias("ord"), F.col(f"missing_{i}").alias("missing"))
        for i, c in enumerate(batch.columns)
    ]
    long = long_form(counted.filter("n > 0"), cells, [F.col("n")])
    pct = F.col("missing") / F.col("n") * 100
    return missing_issues(long.withColumn("pct", pct), threshold)


def missing_issues(counted: DataFrame, threshold: float, *keep: str) -> DataFrame:
    """Issues of the columns ``name, ord, missing, n, pct`` above the threshold, behind the columns to keep."""
    return counted.filter(F.col("pct") > F.lit(threshold)).select(
        *keep,
        *issue_row(
            "completeness",
            row_reference=F.lit("column"),
            column=F.col("name"),
            description=F.concat(
                F.lit("Column '"), "name", F.lit("' is "), fixed_text(F.col("pct"), 1), F.lit("% empty ("),
                F.col("missing").cast("string"), F.lit("/"), F.col("n").cast("string"),
                F.lit(f" rows) — above the {threshold}% threshold"),
            ),
            severity=F.when(F.col("pct") > 50, "high").otherwise("medium"),
            metric=F.col("pct"),
            column_ord=F.col("ord"),
        ),
    )


def group_completeness(batch: Batch, entity: str | None = None, period: str | None = None) -> DataFrame:
    """Entities without a row in a period in which others report.

    Every entity's periods are gathered into an array (never longer than the
    list of periods, cut in chunks when that list is long) and subtracted from
    the full list, so entities and periods are never crossed row by row.
    """
    df, spark = batch.df, batch.df.sparkSession
    if not batch.enabled("completeness"):
        return no_issues(spark)
    entity, period = entity or batch.entity_column, period or batch.period_column
    if not entity or not period or entity not in df.columns or period not in df.columns:
        return no_issues(spark)
    value = lambda c: F.when(~is_missing(df, c), as_text(df, c))
    cells = df.select(value(entity).alias("entity"), value(period).alias("period"))
    shape = cells.agg(
        F.min("entity").alias("low"), F.max("entity").alias("high"), F.count_distinct("period").alias("periods")
    ).first()
    if shape["low"] == shape["high"] or not shape["periods"]:
        return no_issues(spark)
    periods = cells.filter("period is not null").select("period").distinct()
    pairs = cells.filter("entity is not null").distinct()
    if shape["periods"] <= PERIODS_PER_CHUNK:
        # Counted above: a list short enough to be part of the expression.
        expected = F.array(*[F.lit(r["period"]) for r in periods.collect()])
        seen = pairs.groupBy("entity").agg(F.collect_set("period").alias("seen"))
        absent = seen.select("entity", F.explode(F.array_except(expected, "seen")).alias("period"))
    else:
        absent = _absent_by_chunk(pairs, periods, shape["periods"])
    return absence_issues(absent, F.lit(entity), F.lit(period))


def absence_issues(absent: DataFrame, entity_name: Column, period_name: Column, *keep: str) -> DataFrame:
    """Issues of pairs ``entity, period``, behind the columns to keep."""
    place = F.concat(period_name, F.lit("="), "period")
    return absent.select(
        *keep,
        *issue_row(
            "group_completeness",
            row_reference=place,
            column=entity_name,
            description=F.concat(F.lit("'"), "entity", F.lit("' is missing from "), place, F.lit(" despite reporting in other periods")),
            severity=F.lit("high"),
        ),
    )


def _absent_by_chunk(pairs: DataFrame, periods: DataFrame, count: int) -> DataFrame:
    """The same with the periods hashed into chunks, one array per entity and chunk."""
    chunks = math.ceil(count / PERIODS_PER_CHUNK)
    chunk = F.pmod(F.xxhash64("period"), F.lit(chunks)).cast("int").alias("chunk")
    expected = periods.groupBy(chunk).agg(F.collect_list("period").alias("expected"))
    if count <= BROADCAST_MAX_ROWS:
        expected = F.broadcast(expected)  # counted by the caller
    seen = pairs.filter("period is not null").groupBy("entity", chunk).agg(F.collect_set("period").alias("seen"))
    entities = pairs.select("entity").distinct()
    grid = entities.select("entity", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    both = grid.join(seen, ["entity", "chunk"], "left").join(expected, "chunk")
    none = F.array().cast("array<string>")
    return both.select("entity", F.explode(F.array_except("expected", F.coalesce("seen", none))).alias("period"))
