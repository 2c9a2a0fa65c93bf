"""Statistical outliers, per group or over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import BROADCAST_MAX_ROWS
from tablevitals.functions.columns import as_text, is_missing, measure, numeric_columns
from tablevitals.functions.pyformat import float_text
from tablevitals.operators.batch import Batch
from tablevitals.operators.issues import issue_row, no_issues
from tablevitals.operators.quantiles import by_group, from_center, quantiles, value_counts_by_group

# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745


def outlier(batch: Batch, columns: list[str] | None = None, group_by: str | None = None) -> DataFrame:
    """Values far from their group's middle (or the column's, without a group).

    Quantiles are exact and come from the counts of all values, for groups of
    any size on the same path. They go back to the rows as literals (no group)
    or by one join, broadcast only where the figures were counted to be few.
    """
    df, spark = batch.df, batch.df.sparkSession
    if not batch.enabled("outlier"):
        return no_issues(spark)
    params = batch.params("outlier")
    names = [c for c in (columns if columns is not None else numeric_columns(df, batch.columns)) if c in df.columns]
    if not names:
        return no_issues(spark)
    group_by = group_by or params.get("group_by")
    grouped = bool(group_by) and group_by in df.columns
    method = params.get("method", "zscore")
    keys = {str(i): name for i, name in enumerate(names)}
    rows = (df.filter(~is_missing(df, group_by)) if grouped else df).select(
        batch.key.alias("key"),
        (as_text(df, group_by) if grouped else F.lit(None).cast("string")).alias("g"),
        *[measure(df, name).alias(i) for i, name in keys.items()],
    )
    counts = value_counts_by_group(rows, {i: F.col(i) for i in keys}, F.col("g") if grouped else None)
    figures = figures_by_group(counts, params, batch.kept)
    judged = _attach(batch, rows, figures, [c for c in figures.columns if c not in ("g", "c")], len(keys), grouped)
    out = []
    for c, i in enumerate(keys):
        metric, far = judged_value(F.col(i), lambda name, c=c: F.col(f"{name}_{c}"), params)
        out += [metric.alias(f"metric_{i}"), far.alias(f"far_{i}")]
    judged = judged.select("key", "g", *keys, *out)
    cells = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(batch.columns.index(name) if name in batch.columns else int(i)).alias("ord"),
            F.col(i).alias("value"),
            F.col(f"metric_{i}").alias("metric"),
            F.col(f"far_{i}").alias("far"),
        )
        for i, name in keys.items()
    ]
    # Not a filter over all columns: its constraints would multiply with every column while the plan is made.
    flagged = judged.select("key", "g", F.inline(F.filter(F.array(*cells), lambda cell: cell["far"])))
    return far_issues(flagged, method)


def far_issues(flagged: DataFrame, method: str, *keep: str) -> DataFrame:
    """Issues of values ``key, g, name, ord, value, metric``, behind the columns to keep; ``g`` is null without a group."""
    scope = F.coalesce(F.concat(F.lit("'"), "g", F.lit("'")), F.lit("the batch"))
    return flagged.select(
        *keep,
        *issue_row(
            "outlier",
            row_reference=F.col("key"),
            column=F.col("name"),
            description=F.concat(
                F.lit("Value "), float_text(F.col("value")), F.lit(" in "), "name",
                F.lit(f" is a statistical outlier ({method}) relative to "), scope,
                F.lit("'s own history — possible decimal/unit error"),
            ),
            severity=F.lit("medium"),
            row_index=F.col("key").cast("string"),
            value=F.col("value"),
            metric=F.col("metric"),
            column_ord=F.col("ord"),
        ),
    )


def figures_by_group(counts: DataFrame, params: dict, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(g, c)`` and what values are judged by: ``low, high`` or, for z-scores, ``med, mad``; counts are ``(g, c, v, n)``."""
    enough = F.col("n") >= params.get("min_group_size", 3)
    if params.get("method", "zscore") == "iqr":
        factor, low, high = params.get("iqr_multiplier", 1.5), F.col("q")[0], F.col("q")[1]
        return quantiles(counts, [0.25, 0.75], keep).filter(enough).select(
            "g", "c", (low - factor * (high - low)).alias("low"), (high + factor * (high - low)).alias("high")
        )
    counts = keep(counts)
    middles = keep(quantiles(counts, [0.5], keep).filter(enough).select("g", "c", F.col("q")[0].alias("center")))
    few = middles.count() <= BROADCAST_MAX_ROWS
    spreads = quantiles(from_center(counts, middles, few), [0.5], keep).select("g", "c", F.col("q")[0].alias("mad"))
    return middles.withColumnRenamed("center", "med").join(F.broadcast(spreads) if few else spreads, ["g", "c"])


def judged_value(value: Column, figure: Callable[[str], Column], params: dict) -> tuple[Column, Column]:
    """Metric of a value, and whether it lies far off; ``figure`` gives the columns of ``figures_by_group``."""
    if params.get("method", "zscore") == "iqr":
        low, high = figure("low"), figure("high")
        return F.when(value < low, low).otherwise(high), (value < low) | (value > high)
    score = F.when(figure("mad") != 0, F.lit(MAD_SCALE) * (value - figure("med")) / figure("mad"))
    return score, F.abs(score) > params.get("zscore_threshold", 3.5)


def _attach(batch: Batch, rows: DataFrame, figures: DataFrame, names: list[str], columns: int, grouped: bool) -> DataFrame:
    """Rows with their group's figures, ``<name>_<place of the column>``; without a group these are a few literals."""
    wide = by_group(figures, names, columns)
    if grouped:
        wide = batch.kept(wide)
        few = wide.count() * len(names) * columns <= BROADCAST_MAX_ROWS
        return rows.join(F.broadcast(wide) if few else wide, "g")
    row = wide.first()
    literal = lambda name: F.lit(None if row is None else row[name]).cast("double").alias(name)
    return rows.select("*", *[literal(name) for name in wide.columns if name != "g"])
