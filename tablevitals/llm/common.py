"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters that separate words: space and \x09-\x0D, those that ``bytes.split`` takes.
WORD_SPACE = " \t\n\x0b\x0c\r"


def carries_its_code(name: str) -> None:
    """Sends the functions of module ``name`` to tasks by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only where it is unset and the session is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    result = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        result.append(name)
    return result


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returned for ``key``, reused by later tasks of the same Python worker; one at a time is held.

    Functions that travel by value have no module on the worker, so a module
    made there holds it.
    """
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None
        held.value = make()
        held.key = key
    return held.value


def release_kept() -> None:
    """Frees what an earlier operator's tasks left with this worker."""
    held = sys.modules.get("_kept_by_worker")
    if held is not None:
        held.key = held.value = None


def map_column(
    df: DataFrame, column: str, schema: str, start: Callable[[], Callable[[list], list]], rows: int = 2_000, keeps: bool = False,
    drops: bool = False,
) -> DataFrame:
    """``df`` with columns computed in Python from one column, at most ``rows`` rows at a time.

    ``start`` runs once per task and returns a function from a list of values
    (None for null) to one list or array for each column of ``schema``. A new
    column replaces one of the same name. ``keeps`` says that ``start`` keeps
    something with the worker; other operators' tasks free it. ``drops`` leaves
    the column read out of the result, so that it doesn't travel back.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new.names} and not (drops and c == column)]
    (source,) = fresh(df, "value_read")
    added = to_arrow_schema(new)
    # A column that is kept travels once.
    place = kept.index(column) if column in kept else len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release_kept()
        compute = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = part.column(place).to_pylist()
                arrays = [pa.array(x, type=f.type) for x, f in zip(compute(values), added)]
                yield pa.RecordBatch.from_arrays(part.columns[: len(kept)] + arrays, names=kept + added.names)

    read = df.select(*[df[f"`{c}`"] for c in kept], *([] if column in kept else [df[f"`{column}`"].alias(source)]))
    return read.mapInArrow(run, StructType([df.schema[c] for c in kept] + new.fields))


def text_crc32(column: Column | str) -> Column:
    """Unsigned CRC-32 of the value written as text; null for null."""
    return F.crc32(F.encode(F.col(column).cast("string") if isinstance(column, str) else column, "UTF-8"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
