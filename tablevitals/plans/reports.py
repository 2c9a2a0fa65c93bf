"""Report queries over the run, issue, profile and row tables.

Every function takes the tables as DataFrames, so that filters and columns
reach the scan; a filter is only added when it is asked for.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.config import PREVIEW_LIMIT, RUN_LIST_LIMIT
from tablevitals.operators.issues import ISSUE_ORDER
from tablevitals.operators.score import score_band

REPORT_COLUMNS = [
    "dataset_name",
    "run_id",
    "run_timestamp",
    "health_score",
    "rows_processed",
    "rows_flagged",
    "severity",
    "issue_type",
    "row_reference",
    "column",
    "description",
]


def _scoped(runs: DataFrame, dataset_name: str | None) -> DataFrame:
    return runs if dataset_name is None else runs.filter(F.col("dataset_name") == dataset_name)


def dataset_summary(runs: DataFrame) -> DataFrame:
    """Latest run and score figures per dataset, newest first, in one aggregation."""
    latest = F.max_by(
        F.struct("run_id", "timestamp", "health_score", "rows_processed", "rows_flagged"),
        F.struct("timestamp", "run_id"),
    )
    total, count = F.sum("health_score").cast("decimal(38,0)"), F.count(F.lit(1)).cast("decimal(20,0)")
    return (
        runs.groupBy("dataset_name")
        .agg(
            latest.alias("latest"),
            F.count(F.lit(1)).alias("run_count"),
            # Decimal division: the average of whole scores, half up.
            F.round(total / count, 1).cast("double").alias("avg_health_score"),
            F.min("health_score").alias("worst_health_score"),
            F.max("health_score").alias("best_health_score"),
        )
        .select(
            "dataset_name",
            F.col("latest.run_id").alias("latest_run_id"),
            F.col("latest.timestamp").alias("latest_run_at"),
            F.col("latest.health_score").alias("latest_health_score"),
            F.col("latest.rows_processed").alias("rows_processed"),
            F.col("latest.rows_flagged").alias("rows_flagged"),
            "run_count",
            "avg_health_score",
            "worst_health_score",
            "best_health_score",
        )
        .orderBy(F.desc("latest_run_at"), "dataset_name")
    )


def issue_breakdown(runs: DataFrame, issues: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """Issues and affected runs per type and severity.

    Issues are counted per run before the join, so the join and the distinct
    count see one row per run, type and severity.
    """
    per_run = issues.groupBy("run_id", "issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_run.join(_scoped(runs, dataset_name).select("run_id"), "run_id", "left_semi")
        .groupBy("issue_type", "severity")
        .agg(F.sum("n").alias("issue_count"), F.count(F.lit(1)).alias("runs_affected"))
        .orderBy(F.desc("issue_count"), "issue_type", "severity")
    )


def breakdown_pivot(breakdown: DataFrame) -> DataFrame:
    """Issue types as rows, severities as columns."""
    return (
        breakdown.groupBy("issue_type")
        .pivot("severity", ["high", "medium", "low"])
        .agg(F.sum("issue_count"))
        .na.fill(0, ["high", "medium", "low"])
    )


def run_history(runs: DataFrame, dataset_name: str) -> DataFrame:
    return (
        _scoped(runs, dataset_name)
        .select("run_id", "timestamp", "health_score", "rows_processed", "rows_flagged")
        .orderBy("timestamp", "run_id")
    )


def score_trend(runs: DataFrame, dataset_name: str) -> DataFrame:
    """Scores of one dataset in time order, with their band."""
    history = run_history(runs, dataset_name)
    return history.select("run_id", "timestamp", "health_score", score_band(F.col("health_score")).alias("band"))


def issue_history(runs: DataFrame, issues: DataFrame, dataset_name: str) -> DataFrame:
    """Every issue of every run of one dataset with the run's time and score."""
    of_runs = _scoped(runs, dataset_name).select("run_id", F.col("timestamp").alias("run_timestamp"), "health_score")
    listing = [F.asc_nulls_first(c) for c in ISSUE_ORDER if c in issues.columns]
    return (
        issues.join(of_runs, "run_id")
        .orderBy("run_timestamp", "run_id", *listing)
        .select(
            "run_id", "run_timestamp", "health_score", "severity", "issue_type", "row_reference", "column", "description"
        )
    )


def list_runs(
    runs: DataFrame,
    dataset_name: str | None = None,
    limit: int = RUN_LIST_LIMIT,
    before: tuple[datetime, str] | None = None,
) -> DataFrame:
    """The newest runs first (a top-k, no full sort); ``before`` is the timestamp and id of the last run already seen."""
    found = _scoped(runs, dataset_name)
    if before is not None:
        at, run_id = F.lit(before[0]), F.lit(before[1])
        found = found.filter((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("run_id") < run_id)))
    return found.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(limit)


class UnknownRun(LookupError):
    """No finished run has the requested id."""


def require_run(runs: DataFrame, run_id: str) -> None:
    if runs.filter(F.col("run_id") == run_id).isEmpty():
        raise UnknownRun(f"Run '{run_id}' not found")


def run_issues(runs: DataFrame, issues: DataFrame, run_id: str) -> DataFrame:
    require_run(runs, run_id)
    listing = [F.asc_nulls_first(c) for c in ISSUE_ORDER if c in issues.columns]
    found = issues.filter(F.col("run_id") == run_id).orderBy(*listing)
    return found.select("row_reference", "column", "issue_type", "description", "severity")


def run_profile(runs: DataFrame, profiles: DataFrame, run_id: str) -> DataFrame:
    require_run(runs, run_id)
    return profiles.filter(F.col("run_id") == run_id).orderBy("ordinal")


def run_values(runs: DataFrame, values: DataFrame, run_id: str) -> DataFrame:
    """The distinct texts per column of a run's profile, in order."""
    require_run(runs, run_id)
    return values.filter(F.col("run_id") == run_id).orderBy("column", "value").select("column", "value")


def run_preview(runs: DataFrame, rows: DataFrame, run_id: str, limit: int = PREVIEW_LIMIT) -> DataFrame:
    """The first rows of a run in their original order (a top-k)."""
    require_run(runs, run_id)
    return rows.filter(F.col("run_id") == run_id).orderBy("row_index", "row_reference").limit(limit).select("row_index", "data")


def latest_profile(profiles: DataFrame, dataset_name: str) -> DataFrame:
    """The newest stored profile of a dataset; empty when there is none."""
    mine = profiles.filter(F.col("dataset_name") == dataset_name)
    newest = mine.groupBy("dataset_name").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return mine.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")  # one row


def run_report(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per issue with the run's figures; a run without issues keeps one row.

    Written as an inner join and the runs it leaves out: unlike one outer join,
    the inner join can split a run that holds most of the issues.
    """
    texts = ["severity", "issue_type", "row_reference", "column"]
    heads = runs.withColumnRenamed("timestamp", "run_timestamp")
    found = issues.select("run_id", *texts, "description").join(heads, "run_id").select(*REPORT_COLUMNS)
    with_issues = issues.select("run_id").distinct()
    clean = heads.join(with_issues, "run_id", "left_anti").withColumns(
        {**{c: F.lit("") for c in texts}, "description": F.lit("no issues flagged")}
    )
    return found.unionByName(clean.select(*REPORT_COLUMNS))


def printable_report(run: DataFrame, deductions: DataFrame, issues: DataFrame) -> DataFrame:
    """The run report as ordered ``(section, place, line)`` rows, one line per deduction and issue."""
    summary = run.select(
        "run_id",
        F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("place"),
        F.format_string(
            "run %s (dataset: %s) source %s rows %d flagged %d score %d / 100",
            "run_id", "dataset_name", "source_file", "rows_processed", "rows_flagged", "health_score",
        ).alias("line"),
    )
    lost = deductions.select(
        "run_id",
        F.lit(1).alias("section"),
        F.col("place").cast("bigint").alias("place"),
        F.format_string(
            "- %-14s x%-3d @ -%d pts each = -%d pts", "issue_type", "issue_count", "penalty_weight", "points_deducted"
        ).alias("line"),
    )
    found = issues.select(
        "run_id",
        F.lit(2).alias("section"),
        F.coalesce("row_index", F.lit(-1)).cast("bigint").alias("place"),
        F.format_string(
            "[%-6s] %-12s row=%s col=%s: %s",
            F.upper("severity"), "issue_type", "row_reference", "column", "description",
        ).alias("line"),
    )
    return summary.unionByName(lost).unionByName(found)


def write_csv(report: DataFrame, path: str) -> None:
    """CSV export with a header; ``FileNotFoundError`` stands for "nothing to export".

    The report is kept while it is looked at and written, so that its joins and its sort run once.
    """
    kept = report.persist()
    try:
        if kept.isEmpty():
            raise FileNotFoundError("nothing to export")
        kept.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    finally:
        kept.unpersist()
