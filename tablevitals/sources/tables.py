"""Ingest transforms for any table: missing tokens, names, trimming, number typing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.config import NUMERIC_COERCION_RATIO
from tablevitals.functions.columns import ROW_INDEX, col, is_numeric, is_text
from tablevitals.functions.names import standardize_names
from tablevitals.sources.row_index import with_row_index

# Cell texts that mean "missing" in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The numbers and booleans a text column may hold.
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)$"
BOOLEANS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
# Characters a text is stripped of at both ends (Unicode white space), by code.
SPACE_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
]
SPACE = "".join(map(chr, SPACE_CODES))
# First characters of a number or of inf: a quick test before the pattern.
NUMBER_STARTS = [ord(c) for c in "+-.0123456789iI"]


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType) and f.name != ROW_INDEX]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns]) if new else df


def normalize_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing tokens become null. Runs before trimming: ``" "`` is not missing."""
    names = columns if columns is not None else _texts(df)
    return _replace(df, {c: F.when(~col(c).isin(MISSING_TOKENS), col(c)) for c in names})


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*standardize_names(df.columns))


def strip(value: Column) -> Column:
    text = F.trim(value)
    # Nearly all cells begin and end with a visible ASCII character by now.
    visible = lambda c: F.ascii(c).between(0x21, 0x7E)
    clean = (text == "") | (visible(text) & visible(F.substring(text, -1, 1)))
    return F.when(clean, text).otherwise(F.btrim(value, F.lit(SPACE)))


def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns if columns is not None else _texts(df)
    return _replace(df, {c: strip(col(c)) for c in names})


def parse_number(value: Column) -> Column:
    """The text as double where it is a plain number, else null."""
    text = strip(value)
    return F.when(F.ascii(text).isin(NUMBER_STARTS) & text.rlike(NUMBER), text.try_cast("double"))


@dataclass(frozen=True)
class ColumnTypes:
    """Outcome of the typing pass, reusable for later batches of the same feed."""

    numeric: list[str]
    boolean: list[str]
    empty: list[str]


def infer_types(df: DataFrame, ratio: float = NUMERIC_COERCION_RATIO) -> ColumnTypes:
    """One aggregation over all text columns; a few counts per column on the driver."""
    texts = _texts(df)
    if not texts:
        return ColumnTypes([], [], [])
    figures = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(texts):
        figures += [
            F.count(col(c)).alias(f"present_{i}"),
            F.count(parse_number(col(c))).alias(f"numbers_{i}"),
            F.count_if(col(c).isin(list(BOOLEANS))).alias(f"booleans_{i}"),
        ]
    row = df.agg(*figures).first()
    numeric, boolean, empty = [], [], []
    for i, c in enumerate(texts):
        present = row[f"present_{i}"]
        if not present:
            empty.append(c)
        elif row[f"numbers_{i}"] / present >= ratio:
            numeric.append(c)
        elif row[f"booleans_{i}"] == row["n"]:
            boolean.append(c)
    return ColumnTypes(numeric, boolean, empty)


def auto_coerce_numeric(
    df: DataFrame,
    types: ColumnTypes | None = None,
    ratio: float = NUMERIC_COERCION_RATIO,
    from_file: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Text columns that are almost all numbers become double, as do all number columns.

    ``from_file`` adds what typing a text file means: a column without any value
    is double, one of only true/false is boolean. Columns in ``keep`` stay as
    they are (keys of typed tables).
    """
    types = types or infer_types(df, ratio)
    new: dict[str, Column] = {c: parse_number(col(c)) for c in types.numeric if c not in keep}
    if from_file:
        new |= {c: F.lit(None).cast("double") for c in types.empty if c not in keep}
        new |= {c: F.lower(col(c)) == "true" for c in types.boolean if c not in keep}
    for f in df.schema:
        widen = is_numeric(f.dataType) and not isinstance(f.dataType, T.DoubleType)
        if widen and f.name not in keep and f.name != ROW_INDEX:
            new[f.name] = col(f.name).cast("double")
    return _replace(df, new)


def load_table(df: DataFrame, order_by: list[str] | None = None, row_key: str | None = None) -> DataFrame:
    """The ingest path for a table that is already a DataFrame.

    With a ``row_key`` (a unique column) no position is needed; otherwise rows
    are numbered in the order of ``order_by`` (names as in the result).
    """
    named = standardize_columns(df)
    typed = auto_coerce_numeric(trim_strings(named), keep=(row_key,) if row_key else ())
    return typed if row_key else with_row_index(typed, order_by or [])
