"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.pyformat import float_text

# Position of a row in its batch; added by ``with_row_index``, never a data column.
ROW_INDEX = "_row_index"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Measures: every number type, but not booleans."""
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and (columns is None or f.name in columns)]


def text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType) and (columns is None or f.name in columns)]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has one."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def measure(df: DataFrame, name: str) -> Column:
    """A numeric or boolean column as double, with NaN turned into null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    return col(name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """The value as comparable text: what the profile lists and the rules print."""
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(measure(df, name))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    if isinstance(dtype, T.BinaryType):
        return F.base64(col(name))
    return col(name).cast("string")


def groupable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be a grouping key."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.to_json(col(name))
    return col(name)


def long_form(df: DataFrame, cells: list[Column], keep: list[Column]) -> DataFrame:
    """One output row per struct in ``cells``, next to the ``keep`` columns."""
    return df.select(*keep, F.inline(F.array(*cells)))
