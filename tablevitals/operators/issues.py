"""The issue table: one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE_SCHEMA = (
    "row_reference string, column string, issue_type string, description string, severity string, "
    "row_index bigint, value double, metric double, rule_ord int, column_ord int"
)
ISSUE_COLUMNS = [part.split()[0] for part in ISSUE_SCHEMA.split(", ")]

# Order in which findings of one batch are listed.
RULE_ORDER = [
    "completeness",
    "group_completeness",
    "duplicate",
    "validity",
    "outlier",
    "consistency",
    "schema_drift",
]


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def issue_row(
    rule: str,
    *,
    row_reference: Column,
    column: Column,
    description: Column,
    severity: Column,
    row_index: Column | None = None,
    value: Column | None = None,
    metric: Column | None = None,
    column_ord: Column | None = None,
) -> list[Column]:
    """The select list that turns a flagged row into an issue."""
    issue_type = "completeness" if rule == "group_completeness" else rule
    values = {
        "row_reference": row_reference.cast("string"),
        "column": column,
        "issue_type": F.lit(issue_type),
        "description": description,
        "severity": severity,
        "row_index": F.lit(None) if row_index is None else row_index.try_cast("bigint"),
        "value": F.lit(None) if value is None else value,
        "metric": F.lit(None) if metric is None else metric,
        "rule_ord": F.lit(RULE_ORDER.index(rule)),
        "column_ord": F.lit(0) if column_ord is None else column_ord,
    }
    types = dict(part.split() for part in ISSUE_SCHEMA.split(", "))
    return [values[name].cast(types[name]).alias(name) for name in ISSUE_COLUMNS]


# Listing order inside one run; also picks the first N for an alert.
ISSUE_ORDER = ["rule_ord", "column_ord", "row_index", "row_reference", "description"]
