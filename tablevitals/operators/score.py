"""Issue counts, deductions, the health score and what is derived from it.

All take issues of any number of runs with their ``run_id``; the counts are
partial aggregations, so one run may hold most of the issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.config import DEFAULT_PENALTY_WEIGHT, STARTING_SCORE, rule_config
from tablevitals.operators.batch import literal_map


def penalty_weight(issue_type: Column, config: dict | None = None) -> Column:
    """Points per issue; types without a weight cost the default."""
    config = config if config is not None else rule_config()
    weights = {t: p["penalty_weight"] for t, p in config.items() if "penalty_weight" in p}
    return F.coalesce(literal_map(weights, issue_type), F.lit(DEFAULT_PENALTY_WEIGHT)).cast("int")


def issue_counts(issues: DataFrame) -> DataFrame:
    """``(run_id, issue_type, issue_count, first_rule)``; the last orders types as first seen."""
    return issues.groupBy("run_id", "issue_type").agg(
        F.count(F.lit(1)).alias("issue_count"), F.min("rule_ord").alias("first_rule")
    )


def deductions(issues: DataFrame, config: dict | None = None) -> DataFrame:
    """Points per run and issue type, numbered from the largest deduction."""
    weight = penalty_weight(F.col("issue_type"), config)
    counted = issue_counts(issues).withColumn("penalty_weight", weight)
    counted = counted.withColumn("points_deducted", F.col("penalty_weight") * F.col("issue_count"))
    # A handful of issue types per run.
    order = Window.partitionBy("run_id").orderBy(F.desc("points_deducted"), "first_rule", "issue_type")
    return counted.withColumn("place", F.row_number().over(order)).drop("first_rule")


def health_score(runs: DataFrame, issues: DataFrame, config: dict | None = None) -> DataFrame:
    """One row per run in ``runs`` (a run without issues scores the full 100)."""
    weight = penalty_weight(F.col("issue_type"), config)
    # Types per run first, so the run totals come from a few rows each.
    points = (
        issue_counts(issues)
        .groupBy("run_id")
        .agg(F.sum(weight * F.col("issue_count")).alias("lost"), F.sum("issue_count").alias("found"))
    )
    lost = F.coalesce("lost", F.lit(0)).cast("bigint")
    return (
        runs.select("run_id")
        .join(points, "run_id", "left")
        .select(
            "run_id",
            F.greatest(F.lit(0).cast("bigint"), STARTING_SCORE - lost).cast("int").alias("score"),
            F.lit(STARTING_SCORE).alias("starting_score"),
            lost.alias("total_deducted"),
            F.coalesce("found", F.lit(0)).cast("bigint").alias("total_issues"),
        )
    )


def rows_flagged(issues: DataFrame) -> DataFrame:
    """Distinct references per run; ``column``, ``schema`` and each period count as one."""
    return issues.groupBy("run_id").agg(F.count_distinct("row_reference").alias("rows_flagged"))


def run_totals(issues: DataFrame, config: dict | None = None) -> DataFrame:
    """Score, deducted points, issues and flagged references per run with issues, in one pass.

    Issues are first grouped by reference and type, which both the counts and
    the distinct references are computed from.
    """
    weight = penalty_weight(F.col("issue_type"), config)
    by_reference = issues.groupBy("run_id", "row_reference").agg(
        F.sum(weight).alias("lost"),
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    totals = by_reference.groupBy("run_id").agg(
        F.sum("lost").alias("total_deducted"),
        F.sum("found").alias("total_issues"),
        F.sum("high").alias("high_issues"),
        F.count(F.lit(1)).alias("rows_flagged"),
    )
    score = F.greatest(F.lit(0).cast("bigint"), STARTING_SCORE - F.col("total_deducted")).cast("int")
    return totals.withColumn("health_score", score)


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 60, "amber").otherwise("red")
