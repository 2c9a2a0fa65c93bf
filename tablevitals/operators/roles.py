"""Which columns hold the period, the entity and identifiers, by name and cardinality."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tablevitals.config import ENTITY_MIN_DISTINCT, PERIOD_MAX_DISTINCT
from tablevitals.functions.columns import numeric_columns, text_columns
from tablevitals.operators.profile import distinct_counts, value_counts

# Name patterns of period and identifier columns.
PERIOD_NAME = re.compile(r"month|date|year|period|quarter|week|fiscal", re.IGNORECASE)
ID_NAME = re.compile(r"^id$|_id$|^id_|postal.?code|zip.?code", re.IGNORECASE)


def period_like_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [c for c in (columns if columns is not None else df.columns) if PERIOD_NAME.search(c)]


def id_like_numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [c for c in numeric_columns(df, columns) if ID_NAME.search(c)]


def outlier_columns(df: DataFrame, columns: list[str] | None = None, id_columns: list[str] | None = None) -> list[str]:
    """Numeric columns less the identifiers."""
    ids = id_columns if id_columns is not None else id_like_numeric_columns(df, columns)
    return [c for c in numeric_columns(df, columns) if c not in ids]


def guess_period_column(
    df: DataFrame,
    columns: list[str] | None = None,
    distinct: dict[str, int] | None = None,
    max_distinct: int = PERIOD_MAX_DISTINCT,
) -> str | None:
    """The first period-like column, in schema order, that is coarse enough."""
    candidates = period_like_columns(df, columns)
    if distinct is None:
        distinct = distinct_counts(value_counts(df, candidates))
    return next((c for c in candidates if distinct.get(c, 0) <= max_distinct), None)


def unjudged_periods(
    df: DataFrame, columns: list[str], distinct: dict[str, int], max_distinct: int = PERIOD_MAX_DISTINCT
) -> dict[str, int]:
    """Period-like columns that are passed over for their many values, with the number of these."""
    return {c: distinct[c] for c in period_like_columns(df, columns) if distinct.get(c, 0) > max_distinct}


def guess_entity_column(
    df: DataFrame,
    columns: list[str] | None = None,
    exclude: list[str] | None = None,
    distinct: dict[str, int] | None = None,
    rows: int | None = None,
    min_distinct: int = ENTITY_MIN_DISTINCT,
) -> str | None:
    """The text column with the fewest distinct values that still repeats an identity."""
    candidates = [c for c in text_columns(df, columns) if c not in (exclude or [])]
    if distinct is None:
        distinct = distinct_counts(value_counts(df, candidates))
    rows = df.count() if rows is None else rows
    usable = [c for c in candidates if distinct.get(c, 0) >= min_distinct and distinct[c] != rows]
    return min(usable, key=lambda c: distinct[c], default=None) if rows else None
