"""Column profile and value counts.

``stats_row`` is one aggregation over all columns and ``value_counts`` one long
aggregation over all text columns; every rule and report works from these two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import as_text, is_missing, is_numeric, long_form, measure
from tablevitals.functions.pyformat import float_text, round_half_even


def is_measured(dtype: T.DataType) -> bool:
    """Profiled with min/max/mean/std; everything else as text."""
    return is_numeric(dtype) or isinstance(dtype, T.BooleanType)


def stats_aggregates(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates of the stats pass, named ``<figure>_<position>``."""
    out = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(columns):
        out.append(F.count_if(is_missing(df, name)).alias(f"missing_{i}"))
        if is_measured(df.schema[name].dataType):
            value = measure(df, name)
            out += [
                F.min(value).alias(f"min_{i}"),
                F.max(value).alias(f"max_{i}"),
                F.avg(value).alias(f"mean_{i}"),
                F.when(F.count(value) > 1, F.stddev_samp(value))
                .when(F.count(value) == 1, F.lit(0.0))
                .alias(f"std_{i}"),
                F.count_if(value >= 0).alias(f"nonneg_{i}"),
            ]
    return out


def stats_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The stats pass: one row, a few figures per column."""
    return df.agg(*stats_aggregates(df, columns if columns is not None else df.columns))


def value_counts(df: DataFrame, columns: list[str], row_key: str | None = None) -> DataFrame:
    """``(column_ord, column, value, value_count[, first_row])`` for every distinct value.

    ``first_row`` is the smallest row key, which for a value that occurs once is
    its row. Map-side partial counts absorb values that fill much of a column.
    """
    spark = df.sparkSession
    if not columns:
        extra = f", first_row {df.schema[row_key].dataType.simpleString()}" if row_key else ""
        return spark.createDataFrame([], f"column_ord int, column string, value string, value_count bigint{extra}")
    # Floats are counted by the engine's own text and get their final form once per distinct value.
    floats = [i for i, n in enumerate(columns) if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType))]
    text = lambda i, n: measure(df, n).cast("string") if i in floats else as_text(df, n)
    cells = [F.struct(F.lit(i).alias("column_ord"), text(i, n).alias("value")) for i, n in enumerate(columns)]
    keep = [F.col(f"`{row_key}`").alias("row_key")] if row_key else []
    aggregates = [F.count(F.lit(1)).alias("value_count")]
    if row_key:
        aggregates.append(F.min("row_key").alias("first_row"))
    counted = long_form(df, cells, keep).filter("value is not null").groupBy("column_ord", "value").agg(*aggregates)
    names = F.array(*[F.lit(n) for n in columns])
    value = F.col("value")
    if floats:
        value = F.when(F.col("column_ord").isin(floats), float_text(value.try_cast("double"))).otherwise(value)
    return counted.select(
        "column_ord",
        F.element_at(names, F.col("column_ord") + 1).alias("column"),
        value.alias("value"),
        "value_count",
        *(["first_row"] if row_key else []),
    )


def distinct_counts(counts: DataFrame) -> dict[str, int]:
    """Distinct values per column: one small row per column on the driver."""
    return {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count("*").alias("n")).collect()}


def text_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, unique_count)`` of the columns that are not numeric."""
    columns = columns if columns is not None else df.columns
    texts = [n for n in columns if not is_measured(df.schema[n].dataType)]
    return value_counts(df, texts).groupBy("column").agg(F.count("*").alias("unique_count"))


def unique_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full list of distinct values, one row per value, as ``(column, value)``."""
    columns = columns if columns is not None else df.columns
    texts = [n for n in columns if not is_measured(df.schema[n].dataType)]
    return value_counts(df, texts).select("column", "value")


def _profile_cells(df: DataFrame, columns: list[str]) -> list[Column]:
    cells = []
    null_double = F.lit(None).cast("double")
    for i, name in enumerate(columns):
        missing = F.col(f"missing_{i}")
        measured = is_measured(df.schema[name].dataType)
        figure = {
            "min": F.col(f"min_{i}") if measured else null_double,
            "max": F.col(f"max_{i}") if measured else null_double,
            "mean": round_half_even(F.col(f"mean_{i}"), 2) if measured else null_double,
            "std": round_half_even(F.col(f"std_{i}"), 2) if measured else null_double,
        }
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(i).alias("ordinal"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                missing.alias("null_count"),
                F.when(F.col("n") > 0, round_half_even(missing / F.col("n") * 100, 2)).otherwise(0.0).alias("null_pct"),
                *[value.alias(k) for k, value in figure.items()],
            )
        )
    return cells


def numeric_summary(df: DataFrame, columns: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Row count, null share and min/max/mean/std per column, without the text part."""
    columns = columns if columns is not None else df.columns
    stats = stats if stats is not None else stats_table(df, columns)
    return long_form(stats, _profile_cells(df, columns), [F.col("n").alias("row_count")])


def profile_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    distinct: dict[str, int] | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """One row per column: type, nulls, numeric figures or distinct count.

    ``distinct`` and ``stats`` are the results of the two passes where they have run already.
    """
    columns = columns if columns is not None else df.columns
    texts = [n for n in columns if not is_measured(df.schema[n].dataType)]
    base = numeric_summary(df, columns, stats)
    if not texts:
        return base.withColumn("unique_count", F.lit(None).cast("bigint"))
    if distinct is None:
        uniques = value_counts(df, texts).groupBy("column").agg(F.count("*").alias("unique_count"))
    else:
        known = [(c, distinct[c]) for c in texts if c in distinct]
        uniques = df.sparkSession.createDataFrame(known, "column string, unique_count bigint")
    # One row per column on both sides.
    joined = base.join(F.broadcast(uniques), "column", "left")
    unique_count = F.when(F.col("column").isin(texts), F.coalesce("unique_count", F.lit(0)))
    return joined.withColumn("unique_count", unique_count)


def null_badge(profile: DataFrame) -> DataFrame:
    """The profile's null share as a traffic light; null where nothing is missing."""
    badge = F.when(F.col("null_pct") > 20, "red").when(F.col("null_pct") > 0, "amber")
    return profile.withColumn("badge", badge)
