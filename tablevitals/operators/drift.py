"""Columns that are new, gone or of another type since the baseline profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.operators.batch import Batch
from tablevitals.operators.issues import issue_row, no_issues


def current_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [(c, i, df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, now_ord int, now_dtype string")


def schema_drift(batch: Batch, baseline: DataFrame | None) -> DataFrame:
    """Full outer join of the baseline's ``(column, ordinal, dtype)`` rows with the
    schema; both sides have one row per column. Column order does not matter."""
    spark = batch.df.sparkSession
    if not batch.enabled("schema_drift") or baseline is None:
        return no_issues(spark)
    before = baseline.select("column", F.col("ordinal").alias("was_ord"), F.col("dtype").alias("was_dtype"))
    return drift_issues(before.join(current_schema(batch.df, batch.columns), "column", "full_outer"))


def drift_issues(both: DataFrame, *keep: str) -> DataFrame:
    """Issues of columns ``column, was_ord, was_dtype, now_ord, now_dtype``, behind the columns to keep."""
    gone, new = F.col("now_dtype").isNull(), F.col("was_dtype").isNull()
    name = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    changed = both.filter(gone | new | (F.col("now_dtype") != F.col("was_dtype")))
    return changed.select(
        *keep,
        *issue_row(
            "schema_drift",
            row_reference=F.lit("schema"),
            column=F.col("column"),
            description=F.when(
                gone, F.concat(F.lit("Column "), name, F.lit(" present in the previous run is missing from this run"))
            )
            .when(new, F.concat(F.lit("New column "), name, F.lit(" not present in the previous run's schema")))
            .otherwise(
                F.concat(F.lit("Column "), name, F.lit(" changed type from "), "was_dtype", F.lit(" to "), "now_dtype")
            ),
            severity=F.when(gone, "high").when(new, "low").otherwise("medium"),
            # Baseline columns first, in their order, then the new ones.
            column_ord=F.when(new, F.col("now_ord") + 1_000_000).otherwise(F.col("was_ord")),
        ),
    )
