"""Negative values in columns that are almost always non-negative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import col, measure, numeric_columns
from tablevitals.functions.pyformat import fixed_text, float_text
from tablevitals.operators.batch import Batch
from tablevitals.operators.issues import issue_row, no_issues


def validity(batch: Batch, columns: list[str] | None = None) -> DataFrame:
    """The stats pass decides which columns are judged; the second scan reads only
    those columns, with the sign test pushed down to the source."""
    df, spark = batch.df, batch.df.sparkSession
    if not batch.enabled("validity"):
        return no_issues(spark)
    params = batch.params("validity")
    judged: dict[str, float] = {}
    for name in columns if columns is not None else numeric_columns(df, batch.columns):
        if name not in batch.columns:
            continue
        present = batch.rows - batch.stat("missing", name)
        if not present:
            continue
        nonnegative = batch.stat("nonneg", name)
        if batch.stat("min", name) < 0 and not routinely_negative(present, nonnegative, params):
            judged[name] = nonnegative / present
    if not judged:
        return no_issues(spark)
    cells = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(batch.columns.index(name)).alias("ord"),
            measure(df, name).alias("value"),
            F.lit(ratio).alias("ratio"),
        )
        for name, ratio in judged.items()
    ]
    suspects = df.filter(reduce(lambda a, b: a | b, [col(name) < 0 for name in judged]))
    flagged = suspects.select(batch.key.alias("key"), F.inline(F.array(*cells))).filter("value < 0")
    return negative_issues(flagged)


def routinely_negative(present: int, nonnegative: int, params: dict) -> bool:
    """Whether a column has so many negative values that they mean nothing."""
    few = nonnegative / present < params.get("nonnegative_ratio_threshold", 0.95)
    return few and present >= params.get("min_sample_size_for_ratio", 5)


def negative_issues(flagged: DataFrame, *keep: str) -> DataFrame:
    """Issues of values ``key, name, ord, value, ratio``, behind the columns to keep."""
    return flagged.select(
        *keep,
        *issue_row(
            "validity",
            row_reference=F.col("key"),
            column=F.col("name"),
            description=F.concat(
                F.lit("Value "), float_text(F.col("value")), F.lit(" in '"), "name", F.lit("' is negative, but "),
                fixed_text(F.col("ratio") * 100, 0),
                F.lit("% of this column's other values are non-negative — likely a data-entry or unit error"),
            ),
            severity=F.lit("high"),
            row_index=F.col("key").cast("string"),
            value=F.col("value"),
            metric=F.col("ratio"),
            column_ord=F.col("ord"),
        ),
    )
