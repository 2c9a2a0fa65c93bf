"""Rows out of the text of scanned reports."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A line is a label followed by two numbers.
REPORT_LINE = r"([A-Za-z][A-Za-z .&]+?)[\s,]+(-?[\d,]+(?:\.\d+)?)[\s,]+(-?[\d,]+(?:\.\d+)?)"
# White space and decimal digits of any script, inside a character class; two scripts' digits are younger than Java's tables.
WIDE_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WIDE_DIGIT = r"\p{Nd}\x{11f50}-\x{11f59}\x{1e4f0}-\x{1e4f9}"
DIGITS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdecimal())
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
# A label is tried once per run of label characters, from the run's first letter:
# any later start in the run would end at the same numbers. Long lines of plain
# words then take linear time.
LINE_PATTERN = r"(?<![A-Za-z .&])[ .&]*+" + REPORT_LINE.replace(r"\d+)?", rf"[{WIDE_DIGIT}]+)?").replace(r"\d", WIDE_DIGIT).replace(r"\s", WIDE_SPACE)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
REPORT_COLUMNS = ["month", "state_name", "energy_requirement_mu", "energy_availability_mu", "extraction_confidence"]


def _number(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, ",", ""), DIGITS, ASCII_DIGITS).try_cast("double")


def extract_report_rows(
    documents: DataFrame, text: str = "text", month: Column | None = None, keep: list[str] | None = None
) -> DataFrame:
    """One row per line that reads "label number number", from texts of any length.

    ``keep`` passes columns of the document through. Everything extracted this
    way carries a low confidence.
    """
    month = F.coalesce(F.nullif(month, F.lit("")), F.lit("unknown")) if month is not None else F.lit("unknown")
    kept = [F.col(c) for c in keep or []]
    lines = documents.select(
        *kept, month.alias("month"), F.posexplode(F.split(text, LINE_BREAK)).alias("line_no", "line")
    ).filter(F.col("line").rlike(LINE_PATTERN))
    part = lambda n: F.regexp_extract("line", LINE_PATTERN, n)
    label = F.regexp_replace(F.regexp_replace(part(1), f"[{WIDE_SPACE}]+", " "), r"^[ .,-]+|[ .,-]+$", "")
    rows = lines.select(
        *kept,
        "line_no",
        "month",
        label.alias("state_name"),
        _number(part(2)).alias("energy_requirement_mu"),
        _number(part(3)).alias("energy_availability_mu"),
        F.lit("low").alias("extraction_confidence"),
    )
    found = rows.filter("energy_requirement_mu is not null and energy_availability_mu is not null")
    return found.select(*(keep or []), *(["line_no"] if keep else []), *REPORT_COLUMNS)


def drop_confidence(df: DataFrame) -> DataFrame:
    return df.drop("extraction_confidence")
