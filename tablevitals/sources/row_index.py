"""Stable 0-based row positions without bringing rows into one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.functions.columns import ROW_INDEX

# monotonically_increasing_id: partition number above, row in partition below this bit.
ROW_BITS = 33
# File blocks (of about 128 MB) whose positions are broadcast.
BLOCKS_BROADCAST = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; a private folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "tablevitals-checkpoints")
    context.setCheckpointDir(shared)


def with_row_index(df: DataFrame, order_by: list[Column | str], partitions: int | None = None) -> DataFrame:
    """Adds the row's position in the given order.

    Rows are range-partitioned and sorted per partition, with the input
    position as the last sort column so that equal keys spread over tasks. The
    sorted rows are written once to the shared checkpoint folder, which fixes
    the partitions; their sizes, one number each, then turn positions within a
    partition into positions in the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    path = f"{spark.sparkContext.getCheckpointDir()}/ordered-{uuid.uuid4().hex}"
    (
        df.withColumn("_input", F.monotonically_increasing_id())
        .repartitionByRange(partitions, *order, "_input")
        .sortWithinPartitions(*order, "_input")
        .drop("_input")
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    ordered = spark.read.parquet(path)
    part = F.shiftright("_at", ROW_BITS).cast("int")
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    starts = spark.createDataFrame(list(enumerate(offsets)), "_part int, _start bigint")
    within = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(ROW_INDEX, F.col("_start") + within)
        .drop("_part", "_start", "_at")
    )


def with_file_row_index(df: DataFrame, path: str = "_path", block: str = "_block", per_file: bool = False) -> DataFrame:
    """Adds the row's position to rows read with their file path and block start.

    Files follow each other by path, rows as they stand in their file. With
    ``per_file`` positions begin anew in every file, and the path stays.

    A task reads a file block from front to back, so a row's place in its block
    is its distance from the block's first row. Block sizes are added up per
    file; no row is moved for it unless there are too many blocks to broadcast.
    """
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    blocks = numbered.groupBy(path, block).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(path).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    files = len(df.inputFiles())
    if files > 1 and not per_file:
        starts = _after_earlier_files(starts, blocks, path)
    # A task reads one block of a large file or several small files.
    most_blocks = df.rdd.getNumPartitions() + files
    if most_blocks <= BLOCKS_BROADCAST:
        starts = F.broadcast(starts)
    return (
        numbered.join(starts, [path, block])
        .withColumn(ROW_INDEX, F.col("_start") + F.col("_at") - F.col("_first"))
        .drop("_at", "_first", "_start", *([] if per_file else [path]), block)
    )


def _after_earlier_files(starts: DataFrame, blocks: DataFrame, path: str) -> DataFrame:
    """Block positions moved behind the rows of all earlier files; one number per file."""
    sizes = blocks.groupBy(path).agg(F.sum("_rows").alias("rows")).orderBy(path).collect()
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r[path], total))
        total += r["rows"]
    table = starts.sparkSession.createDataFrame(offsets, f"{path} string, _offset bigint")
    if len(offsets) <= BLOCKS_BROADCAST:
        table = F.broadcast(table)
    return starts.join(table, path).withColumn("_start", F.col("_start") + F.col("_offset")).drop("_offset")
