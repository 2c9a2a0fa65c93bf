"""Which runs need attention, and the message for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.config import ALERT_ISSUE_LIMIT, ALERT_SCORE_THRESHOLD
from tablevitals.operators.issues import ISSUE_ORDER


def _high_counts(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("severity") == "high").groupBy("run_id").agg(F.count(F.lit(1)).alias("high_issues"))


def should_alert(runs: DataFrame, issues: DataFrame, threshold: int = ALERT_SCORE_THRESHOLD) -> DataFrame:
    """Runs with ``high_issues`` and the flag ``alert``: a low score or any high-severity issue."""
    high = F.coalesce("high_issues", F.lit(0)).cast("bigint")
    return (
        runs.join(_high_counts(issues), "run_id", "left")
        .withColumn("high_issues", high)
        .withColumn("alert", (F.col("health_score") < threshold) | (F.col("high_issues") > 0))
    )


def alert_message(
    runs: DataFrame,
    issues: DataFrame,
    threshold: int = ALERT_SCORE_THRESHOLD,
    limit: int = ALERT_ISSUE_LIMIT,
) -> DataFrame:
    """``(run_id, message)`` for every run that needs an alert.

    The window keeps the first ``limit`` issues per run in every task before
    the shuffle; only those texts are gathered per run.
    """
    order = [c for c in ISSUE_ORDER if c in issues.columns]
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(*[F.asc_nulls_first(c) for c in order]))
    line = F.concat(F.lit("  • ["), "issue_type", F.lit("] "), "description")
    top = (
        issues.filter(F.col("severity") == "high")
        .withColumn("nth", nth)
        .filter(F.col("nth") <= limit)
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("lines"))
        .select("run_id", F.col("lines.line").alias("lines"))
    )
    flagged = should_alert(runs, issues, threshold).filter("alert").join(top, "run_id", "left")
    text = lambda c: F.col(c).cast("string")
    head = F.array(
        F.concat(F.lit(":rotating_light: *Data Quality Alert* — run `"), "run_id", F.lit("`")),
        F.concat(F.lit("*Source:* "), "source_file"),
        F.concat(F.lit("*Health score:* "), text("health_score"), F.lit(f"/100 (alert threshold: {threshold})")),
        F.concat(
            F.lit("*Rows processed:* "), text("rows_processed"), F.lit(" · *Rows flagged:* "), text("rows_flagged")
        ),
    )
    high = F.when(
        F.col("high_issues") > 0,
        F.concat(
            F.array(F.concat(F.lit("\n*"), text("high_issues"), F.lit(" high-severity issue(s):*"))),
            "lines",
            F.when(
                F.col("high_issues") > limit,
                F.array(F.concat(F.lit("  … and "), (F.col("high_issues") - limit).cast("string"), F.lit(" more"))),
            ).otherwise(F.array().cast("array<string>")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return flagged.select("run_id", F.array_join(F.concat(head, high), "\n").alias("message"))


def alert_batch(runs: DataFrame, issues: DataFrame, run_ids: DataFrame | None = None, **kwargs) -> DataFrame:
    """Alert rows for the runs of one batch; ``run_ids`` limits both tables to them first.

    A batch run is reported under its dataset name, without row totals, and
    only its high-severity findings count as flagged.
    """
    if run_ids is not None:
        runs = runs.join(run_ids.select("run_id"), "run_id", "left_semi")
        issues = issues.join(run_ids.select("run_id"), "run_id", "left_semi")
    high = _high_counts(issues)
    view = (
        runs.select("run_id", "dataset_name", "health_score")
        .join(high, "run_id", "left")
        .select(
            "run_id",
            "health_score",
            F.col("dataset_name").alias("source_file"),
            F.lit(0).alias("rows_processed"),
            F.coalesce("high_issues", F.lit(0)).alias("rows_flagged"),
        )
    )
    return alert_message(view, issues, **kwargs)
