"""The run store: parquet tables under one folder, partitioned by run and attempt.

Every attempt at a run writes files of its own. ``quality_runs``, written last,
makes the attempt the run's visible one; readers of all tables see the rows of
visible attempts only. So a reader sees a run as it was or as it is, never a
mixture, while the run is written again, and the files of the attempt before
stay until the next begins.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import ROW_INDEX, col
from tablevitals.operators.alerts import alert_batch
from tablevitals.operators.batch import literal_map
from tablevitals.operators.issues import ISSUE_SCHEMA

RUN_SCHEMA = (
    "run_id string, timestamp timestamp, source_file string, dataset_name string, "
    "health_score int, rows_processed bigint, rows_flagged bigint"
)
PROFILE_SCHEMA = (
    "run_id string, dataset_name string, created_at timestamp, row_count bigint, column string, ordinal int, "
    "dtype string, null_count bigint, null_pct double, min double, max double, mean double, std double, "
    "unique_count bigint"
)
SCHEMAS = {
    "quality_runs": RUN_SCHEMA,
    "quality_issues": "run_id string, " + ISSUE_SCHEMA,
    "dataset_rows": "run_id string, row_index bigint, row_reference string, data string",
    "dataset_profiles": PROFILE_SCHEMA,
    "profile_values": "run_id string, column string, value string",
    "data_lineage": (
        "run_id string, source_file string, ingested_at timestamp, "
        "transformations_applied array<string>, destination_table string"
    ),
    "alerts": "run_id string, message string",
    "run_notes": "run_id string, column string, note string",
}
# The steps every stored batch went through.
LINEAGE_STEPS = ["load_structured", "profile_dataframe", "run_all_rules", "compute_health_score"]


def json_safe(df: DataFrame, name: str) -> Column:
    """The column without NaN and infinities, which JSON cannot hold."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        infinite = F.abs(value) == F.lit(float("inf"))
        value = F.when(~F.isnan(value) & ~infinite, value)
    return value.alias(name)


def json_safe_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON text; missing values stay as explicit nulls."""
    columns = columns if columns is not None else [c for c in df.columns if c != ROW_INDEX]
    return F.to_json(F.struct(*[json_safe(df, c) for c in columns]), {"ignoreNullFields": "false"})


def rows_table(df: DataFrame, run_id: str | Column, row_key: str = ROW_INDEX, columns: list[str] | None = None):
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    key = col(row_key).cast("string")
    return df.select(
        run.alias("run_id"),
        key.try_cast("bigint").alias("row_index"),  # null for keys that are not numbers
        key.alias("row_reference"),
        json_safe_record(df, columns).alias("data"),
    )


def runs_table(spark: SparkSession, **run) -> DataFrame:
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    known = {k: v for k, v in run.items() if k != "timestamp"}
    row = spark.createDataFrame([tuple(known.get(n) for n in names)], RUN_SCHEMA)
    return row if run.get("timestamp") is None else row.withColumn("timestamp", F.lit(run["timestamp"]))


def lineage_table(runs: DataFrame, destination: str = "dataset_rows") -> DataFrame:
    """Source, steps and destination of every run in ``runs``."""
    return runs.select(
        "run_id",
        "source_file",
        F.col("timestamp").alias("ingested_at"),
        F.array(*[F.lit(s) for s in LINEAGE_STEPS]).alias("transformations_applied"),
        F.lit(destination).alias("destination_table"),
    )


def profile_table(profile: DataFrame, runs: DataFrame) -> DataFrame:
    """The column profile keyed by its run and dataset. ``runs`` has one row."""
    run = runs.select("run_id", "dataset_name", F.col("timestamp").alias("created_at")).first()
    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    return profile.select(
        F.lit(run["run_id"]).alias("run_id"),
        F.lit(run["dataset_name"]).alias("dataset_name"),
        F.lit(run["created_at"]).alias("created_at"),
        *names[3:],
    )


class RunStore:
    """Run ids are plain names (letters, digits, ``-`` and ``_``): they name folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.attempts: dict[str, str] = {}  # the runs that this store object writes

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _file_system(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _exists(self, table: str) -> bool:
        system, path = self._file_system(self.path(table))
        return system.exists(path)

    def stage(self, df: DataFrame, run_id: str) -> DataFrame:
        """The table written once as parquet, for the scans of one run."""
        path = self.path(f"staging/{run_id}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_staged(self, run_id: str) -> None:
        system, path = self._file_system(self.path(f"staging/{run_id}"))
        system.delete(path, True)

    def begin(self, run_ids: list[str]) -> None:
        """New attempts at these runs; what earlier attempts left goes, but for the visible ones, which may be being read."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for run_id in run_ids:
            left = {table: self._attempts_of(table, run_id) for table in SCHEMAS}
            visible = max(left["quality_runs"], default=None)
            for table, attempts in left.items():
                for attempt in attempts - {visible}:
                    system, path = self._file_system(self.path(f"{table}/run_id={run_id}/attempt={attempt}"))
                    system.delete(path, True)
            self.attempts[run_id] = name

    def _attempts_of(self, table: str, run_id: str) -> set[str]:
        system, path = self._file_system(self.path(f"{table}/run_id={run_id}"))
        folders = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return {f.removeprefix("attempt=") for f in folders if f.startswith("attempt=")}

    def _attempt(self) -> Column:
        """The attempt that rows with a ``run_id`` belong to when this object writes them."""
        return F.coalesce(literal_map(self.attempts, F.col("run_id")).cast("string"), F.lit("0"))

    def append(self, table: str, rows: DataFrame) -> None:
        """Writes the runs in ``rows``, replacing what the same attempts wrote to the table."""
        schema = T.StructType.fromDDL(SCHEMAS[table])
        typed = rows.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        typed = typed.withColumn("attempt", self._attempt())
        (
            typed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id", "attempt")
            .parquet(self.path(table))
        )

    def _read(self, table: str, run_id: str | None = None) -> DataFrame:
        """All attempts' rows, with ``attempt``, of the table or, without listing the others, of one run."""
        schema = T.StructType.fromDDL(SCHEMAS[table]).add("attempt", "string")
        part = f"{table}/run_id={run_id}" if run_id is not None else table
        if not self._exists(part):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path(table))
        return reader.parquet(self.path(part)).select(*schema.names)

    def _finished(self, table: str) -> DataFrame:
        visible = self._read("quality_runs").groupBy("run_id").agg(F.max("attempt").alias("attempt"))
        return self._read(table).join(visible, ["run_id", "attempt"], "left_semi").drop("attempt")

    def _mine(self, table: str, run_ids: list[str]) -> DataFrame:
        """What this object's attempts at runs wrote, visible or not; only these runs' partitions are read."""
        rows = self._read(table).filter(F.col("run_id").isin(run_ids) & (F.col("attempt") == self._attempt()))
        return rows.drop("attempt")

    def runs(self) -> DataFrame:
        return self._finished("quality_runs")

    def issues(self) -> DataFrame:
        return self._finished("quality_issues")

    def rows(self) -> DataFrame:
        return self._finished("dataset_rows")

    def profiles(self) -> DataFrame:
        return self._finished("dataset_profiles")

    def values(self) -> DataFrame:
        return self._finished("profile_values")

    def lineage(self) -> DataFrame:
        return self._finished("data_lineage")

    def alerts(self) -> DataFrame:
        return self._finished("alerts")

    def notes(self) -> DataFrame:
        """What the rules of a run left out, by column."""
        return self._finished("run_notes")

    def store_notes(self, notes: list[tuple[str, str, str]]) -> None:
        """Rows ``(run_id, column, note)``: at most a few for each column."""
        if notes:
            self.append("run_notes", self.spark.createDataFrame(notes, SCHEMAS["run_notes"]))

    def store_alerts(self, run_ids: list[str]) -> None:
        """Alert rows of these runs, of which at most one batch's are given; a run without need of one has none."""
        if not run_ids:
            return
        self.append("alerts", alert_batch(self._mine("quality_runs", run_ids), self._mine("quality_issues", run_ids)))

    def store_rows(self, df: DataFrame, run_id: str, row_key: str = ROW_INDEX, columns=None) -> None:
        self.append("dataset_rows", rows_table(df, run_id, row_key, columns))

    def store_issues(self, issues: DataFrame, run_id: str) -> None:
        self.append("quality_issues", issues.withColumn("run_id", F.lit(run_id)))

    def store_profile(self, profile: DataFrame, run: DataFrame) -> None:
        self.append("dataset_profiles", profile_table(profile, run))

    def store_values(self, values: DataFrame, run_id: str) -> None:
        self.append("profile_values", values.withColumn("run_id", F.lit(run_id)))

    def store_lineage(self, run: DataFrame) -> None:
        self.append("data_lineage", lineage_table(run))

    def store_run(self, run: DataFrame) -> None:
        self.append("quality_runs", run)

    def issues_of(self, run_ids: list[str]) -> DataFrame:
        """Issues of the runs of one batch, before they are marked finished."""
        return self._mine("quality_issues", run_ids)

    def latest_columns(self, datasets: list[str]) -> dict[str, list[tuple[str, int, str]]]:
        """Name, place and type of the columns in the newest finished profile of each of one batch's datasets."""
        mine = self.profiles().filter(F.col("dataset_name").isin(list(set(datasets))))
        newest = mine.groupBy("dataset_name").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
        columns: dict[str, list] = {}
        for r in mine.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi").select("dataset_name", "column", "ordinal", "dtype").collect():
            columns.setdefault(r["dataset_name"], []).append((r["column"], r["ordinal"], r["dtype"]))
        return columns

    def stored_issues(self, run_id: str) -> DataFrame:
        """A run's issues before it is marked finished (read back by its own writer)."""
        return self._read("quality_issues", run_id).filter(F.col("attempt") == self._attempt()).drop("attempt")
