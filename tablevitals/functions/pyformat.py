"""Number texts for descriptions and rounded profile figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(value: Column) -> Column:
    """Shortest text of a double: plain digits up to 1e16 and down to 1e-4,
    ``1.5e+16`` / ``1.5e-05`` beyond."""
    text = value.cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.", ""), r"(?<=.)0+$", "")
    rest = F.expr("''")
    scientific = F.concat(
        sign,
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(rest),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(rest),
        F.abs(exponent).cast("string"),
    )
    fraction = F.substr(digits, exponent + F.lit(2))
    large = F.concat(
        sign,
        F.rpad(F.substr(digits, F.lit(1), exponent + F.lit(1)), exponent + F.lit(1), F.lit("0")),
        F.lit("."),
        F.when(F.length(fraction) > 0, fraction).otherwise(F.lit("0")),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - F.lit(1)), digits)
    size = F.abs(value)
    # The engine's own text agrees in this range, which nearly all values are in.
    usual = (value == 0) | ((size >= 1e-3) & (size < 1e7))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(usual, text)
        .when(F.isnan(value), F.lit("nan"))
        .when(text == "Infinity", F.lit("inf"))
        .when(text == "-Infinity", F.lit("-inf"))
        .when(exponent.isNull(), text)
        .when((exponent >= 16) | (exponent < -4), scientific)
        .when(exponent >= 0, large)
        .otherwise(small)
    )


def fixed_text(value: Column, decimals: int) -> Column:
    """Text with a fixed number of decimals, halves of the binary value to even."""
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", value, F.lit(pattern))


def round_half_even(value: Column, decimals: int) -> Column:
    """Rounded to ``decimals`` by the value's binary form, halves to even."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, fixed_text(value, decimals).try_cast("double")).otherwise(value)
