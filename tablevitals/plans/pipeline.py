"""One batch through profile, rules and score, and into the run store."""

from __future__ import annotations

import hashlib
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Callable

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.functions.columns import ROW_INDEX
from tablevitals.operators import roles
from tablevitals.operators.batch import Batch
from tablevitals.operators.completeness import completeness, group_completeness
from tablevitals.operators.consistency import consistency
from tablevitals.operators.drift import schema_drift
from tablevitals.operators.duplicates import duplicate
from tablevitals.operators.outliers import outlier
from tablevitals.operators.profile import profile_columns, unique_values
from tablevitals.operators.score import run_totals
from tablevitals.operators.validity import validity
from tablevitals.plans.reports import latest_profile
from tablevitals.plans.store import RunStore, runs_table

# Rule name -> (batch, baseline profile) -> issues. A new rule is one more entry.
RULES: dict[str, Callable[[Batch, DataFrame | None], DataFrame]] = {
    "completeness": lambda batch, _: completeness(batch),
    "group_completeness": lambda batch, _: group_completeness(batch),
    "duplicate": lambda batch, _: duplicate(batch),
    "validity": lambda batch, _: validity(batch),
    "outlier": lambda batch, _: outlier(
        batch, roles.outlier_columns(batch.df, batch.columns, batch.id_columns), batch.entity_column
    ),
    "consistency": lambda batch, _: consistency(batch),
    "schema_drift": schema_drift,
}


def side_by_side(spark: SparkSession, *tasks: Callable) -> list:
    """Runs tasks that submit Spark jobs at the same time; results in order."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


def run_all_rules(batch: Batch, baseline: DataFrame | None = None) -> DataFrame:
    """Issues of all enabled rules; ``rule_ord`` keeps the listing order.

    Entity and period columns are guessed unless the batch names them. The two
    shared passes come first; what the rules then ask the cluster before their
    plans are complete (group counts, quantiles, frequent values) runs at the
    same time.
    """
    uses_values = any(batch.enabled(rule) for rule in ("completeness", "outlier", "consistency"))
    spark = batch.df.sparkSession
    side_by_side(spark, lambda: batch.stats, lambda: batch.value_stats if uses_values else None)
    if uses_values:
        batch.entity_column, batch.period_column  # noqa: B018
    rules = [lambda rule=rule: rule(batch, baseline) for rule in RULES.values()]
    return reduce(DataFrame.unionByName, side_by_side(spark, *rules))


@dataclass
class RunResult:
    run_id: str
    run: DataFrame
    issues: DataFrame
    profile: DataFrame
    summary: dict
    notes: list  # (column, note): what the rules left out


def new_run_id() -> str:
    return str(uuid.uuid4())[:8]


def file_run_id(path: str, length: int, modified: str) -> str:
    """The same id for the same file version, so that a retried file replaces itself."""
    return hashlib.sha256(f"{path}|{length}|{modified}".encode()).hexdigest()[:16]


def run_batch(
    spark: SparkSession,
    df: DataFrame,
    *,
    dataset_name: str,
    source_file: str = "",
    store: RunStore | None = None,
    baseline: DataFrame | None = None,
    row_key: str = ROW_INDEX,
    run_id: str | None = None,
    config: dict | None = None,
    timestamp: datetime | None = None,
    stage: bool = False,
    keep_values: bool = True,
    group_by: str | None = None,
    period_by: str | None = None,
    id_columns: list[str] | None = None,
) -> RunResult:
    """Profiles, checks and scores a table; with a store, keeps everything by run.

    The baseline for schema drift is the dataset's newest stored profile unless
    one is given. Issues are materialised once: in the store's issue table, or
    without a store on the executors (memory, then disk). ``stage`` first writes
    the table as parquet to the store; the rules scan it several times, and then
    read typed columns instead of parsing text again. ``keep_values``
    stores the full list of distinct texts per column as part of the profile.
    ``group_by``, ``period_by`` and ``id_columns`` name the entity, the period and
    the identifiers; they are guessed where not given.
    """
    run_id = run_id or new_run_id()
    if not re.fullmatch(r"[\w-]+", run_id):
        raise ValueError(f"run id {run_id!r} is not a plain name")
    if store is not None:
        store.begin([run_id])
        df = store.stage(df, run_id) if stage else df
    if baseline is None and store is not None:
        baseline = latest_profile(store.profiles(), dataset_name)
    if baseline is not None and baseline.isEmpty():
        baseline = None
    batch = Batch(df, row_key, config=config, group_by=group_by, period_by=period_by, id_columns=id_columns)
    try:
        issues = run_all_rules(batch, baseline)
        profile = profile_columns(df, batch.columns, batch.distinct, batch.stats_table())
        notes = batch.notes
        if store is not None:
            store.store_issues(issues, run_id)
            issues = store.stored_issues(run_id)
        else:
            issues = issues.withColumn("run_id", F.lit(run_id)).persist(StorageLevel.MEMORY_AND_DISK)
        totals = run_totals(issues, batch.config).first()
        summary = {
            "run_id": run_id,
            "dataset_name": dataset_name,
            "source_file": source_file,
            "timestamp": timestamp or datetime.now(timezone.utc),
            "rows_processed": batch.rows,
            "rows_flagged": totals["rows_flagged"] if totals else 0,
            "health_score": totals["health_score"] if totals else 100,
            "total_issues": totals["total_issues"] if totals else 0,
            "high_issues": totals["high_issues"] if totals else 0,
        }
        run = runs_table(spark, **summary)
        if store is not None:
            writes = [
                lambda: store.store_rows(df, run_id, row_key, batch.columns),
                lambda: store.store_profile(profile, run),
                lambda: store.store_lineage(run),
                lambda: store.store_notes([(run_id, *n) for n in notes]),
            ]
            if keep_values:
                writes.append(lambda: store.store_values(unique_values(df, batch.columns), run_id))
            side_by_side(spark, *writes)
            store.store_run(run)  # the commit marker
            profile = store.profiles().filter(F.col("run_id") == run_id)
        else:
            # One row per column; kept small on the driver so the batch can be released.
            profile = spark.createDataFrame(profile.collect(), profile.schema)
    finally:
        batch.release()
        if stage and store is not None:
            store.drop_staged(run_id)
    return RunResult(run_id, run, issues, profile, summary, notes)
