"""A folder of arriving files as a stream of batches."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablevitals.functions.columns import ROW_INDEX
from tablevitals.plans.grouped import ingest_files
from tablevitals.plans.pipeline import file_run_id, run_batch
from tablevitals.plans.store import RunStore
from tablevitals.sources.csv import load_csv
from tablevitals.sources.files import route_files
from tablevitals.sources.reports import drop_confidence, extract_report_rows
from tablevitals.sources.row_index import with_row_index

log = logging.getLogger(__name__)

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
QUARANTINE_SCHEMA = "run_id string, path string, reason string"


def arriving_files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New files as rows of name, size and time; their content is not read."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    return files.select("path", "length", F.col("modificationTime").cast("string").alias("modified"))


def load_file(spark: SparkSession, file) -> DataFrame:
    if file["route"] == "structured":
        return load_csv(spark, file["path"])
    text = spark.read.text(file["path"]).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = extract_report_rows(text, "text", F.lit(file["month"]), keep=["at"])
    return drop_confidence(with_row_index(rows, ["at", "line_no"]).drop("at", "line_no"))


def process_file(spark: SparkSession, store: RunStore, file, config: dict | None = None) -> tuple | None:
    """One file through the whole path; the reason when it has to be set aside."""
    run_id = file_run_id(file["path"], file["length"], file["modified"])
    if file["route"] == "quarantine":
        return run_id, file["path"], file["reason"]
    try:
        df = load_file(spark, file)
        if df.isEmpty():
            return run_id, file["path"], "no rows"
        run_batch(
            spark,
            df,
            dataset_name=file["dataset_name"],
            source_file=file["path"],
            store=store,
            run_id=run_id,
            row_key=ROW_INDEX,
            config=config,
            stage=True,
        )
    except Exception as error:  # one bad file does not stop the others
        log.exception("failed to process %s", file["path"])
        return run_id, file["path"], f"failed: {error}"
    return None


def one_by_one(spark: SparkSession, store: RunStore, files: list, config: dict | None, parallel: int) -> list[tuple]:
    """Each file by jobs of its own; datasets side by side."""
    by_dataset: dict[str, list] = {}
    for file in files:
        by_dataset.setdefault(file["dataset_name"], []).append(file)
    with ThreadPoolExecutor(parallel) as pool:
        # Each thread passes the stream's job properties on.
        one_dataset = lambda group: [process_file(spark, store, file, config) for file in group]
        results = [row for group in pool.map(inheritable_thread_target(spark)(one_dataset), by_dataset.values()) for row in group]
    stored = [f for group in by_dataset.values() for f in group]
    store.store_alerts([file_run_id(f["path"], f["length"], f["modified"]) for f, row in zip(stored, results) if row is None])
    return [row for row in results if row is not None]


def batch_writer(
    store: RunStore, quarantine: str, config: dict | None = None, parallel: int = 4, report_text: bool = True
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function.

    At most ``maxFilesPerTrigger`` names reach the driver. All files of the
    micro-batch are checked and stored by the same grouped jobs. Should these
    fail, the files run one by one, so that a file nobody can read is set aside
    alone; those of one dataset then in name order, because each is the next
    one's baseline.
    """

    def write(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        local = RunStore(spark, store.root)
        routed = route_files(files, report_text=report_text).orderBy("path").collect()
        run_of = lambda f: file_run_id(f["path"], f["length"], f["modified"])
        aside = [(run_of(f), f["path"], f["reason"]) for f in routed if f["route"] == "quarantine"]
        files = [f for f in routed if f["route"] != "quarantine"]
        try:
            aside += ingest_files(spark, local, files, [run_of(f) for f in files], config) if files else []
        except Exception:
            log.exception("the files of batch %s are processed one by one", batch_id)
            aside += one_by_one(spark, local, files, config, parallel)
        if aside:
            rows = spark.createDataFrame(aside, QUARANTINE_SCHEMA)
            (
                rows.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("run_id")
                .parquet(quarantine)
            )

    return write


def ingest_folder(
    spark: SparkSession,
    folder: str,
    store: RunStore,
    checkpoint: str,
    *,
    quarantine: str | None = None,
    config: dict | None = None,
    interval: str | None = None,
    max_files: int = 100,
    parallel: int = 4,
) -> StreamingQuery:
    """Starts the stream: all files now in the folder, or with ``interval`` every so often.

    The checkpoint remembers which files were taken; a file retried after a
    failure has the same run id and replaces its own partitions.
    """
    quarantine = quarantine or store.path("quarantine")
    writer = arriving_files(spark, folder, max_files).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(batch_writer(store, quarantine, config, parallel))
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
