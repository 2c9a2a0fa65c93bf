"""Whitening of embeddings from variances alone.

For two columns a and b, var(a + b) - var(a) - var(b) is twice their covariance.
So one aggregation of squares, of every dimension and of the sum of every two,
gives the whole covariance matrix. Vectors are whole numbers, centred before
they are squared, and all sums are exact: the values are taken relative to the
whole number below their mean, and what the mean has beyond it is put right in
whole numbers afterwards. Rows never leave their tasks; what is fetched is one
number for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablevitals.llm.common import carries_its_code, written

carries_its_code(__name__)

SUMS = "k int, s decimal(38,0)"
# Entries that a task looks at together.
CELLS = 1 << 20
INT64 = 1 << 62


@dataclass(frozen=True)
class WhitenParameters:
    scale: int = 64
    offset: int = 1_000_000
    components: int = 32


def whole_numbers(vectors: pa.Array, dimensions: int, p: WhitenParameters) -> np.ndarray:
    """``floor(scale * x) + offset`` of every entry, one row for each vector."""
    values = np.floor(p.scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise ValueError("a vector has an entry that is no 64-bit whole number after scaling")
    return values.astype(np.int64).reshape(-1, dimensions) + p.offset


def parts(batches: Iterable[pa.RecordBatch], column: int, dimensions: int, p: WhitenParameters) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, CELLS // dimensions)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, whole_numbers(part.column(column), dimensions, p)


def totals(rows: DataFrame, width: int, add: Callable[[Iterable[pa.RecordBatch], list], None], kind: str = "decimal(38,0)") -> list:
    """The sums of ``width`` numbers over all rows: ``add`` adds those of a task to a list."""
    exact = kind.startswith("decimal")
    schema = StructType.fromDDL(f"k int, s {kind}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list = [0] * width
        add(batches, mine)
        values = pa.array([Decimal(v) for v in mine] if exact else [float(v) for v in mine], arrow[1].type)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), values], schema=arrow)

    sums = rows.mapInArrow(run, schema).groupBy("k").agg(F.sum("s").alias("s")).collect()
    result: list = [0] * width
    for r in sums:
        result[r["k"]] = int(r["s"]) if exact else r["s"]
    return result


def column_sums(x: np.ndarray) -> list[int]:
    most = int(np.abs(x).max(initial=0))
    return (x if most * len(x) < INT64 else x.astype(object)).sum(axis=0).tolist()


def pair_squares(d: np.ndarray) -> list[int]:
    """Sums of squares of every column and of the sum of every two, in the order (0), (0, 1), (0, 2), ... (1), (1, 2), ..."""
    most = 2 * int(np.abs(d).max(initial=0)) + 1
    if most * most * len(d) >= INT64:
        if len(d) > 1:
            halves = (pair_squares(d[: len(d) // 2]), pair_squares(d[len(d) // 2 :]))
            return [a + b for a, b in zip(*halves)]
        d = d.astype(object)
    out: list[int] = []
    for i in range(d.shape[1]):
        both = d[:, i:] + d[:, i : i + 1]
        both[:, 0] = d[:, i]
        out += (both * both).sum(axis=0).tolist()
    return out


@dataclass(frozen=True)
class Whitening:
    """What all rows share: count, sums, components with variance, and their eigenvalues' share of the trace."""

    n: int
    floors: list[int]  # whole number below each mean
    rests: list[int]  # n * (mean - floor)
    axes: list[list[float]]  # unit eigenvectors
    eigenvalues: list[float]
    explained: list[float]


def covariance(n: int, rests: list[int], squares: list[int]) -> np.ndarray:
    """Covariances from exact sums of squares by polarisation, each the double nearest to the exact value."""
    size = len(rests)
    at = iter(squares)
    # n**3 times the variance of a column or of the sum of two, with the means' rests taken out.
    alone, both = [0] * size, {}
    for i in range(size):
        alone[i] = n * n * next(at) - n * rests[i] ** 2
        for j in range(i + 1, size):
            both[i, j] = n * n * next(at) - n * (rests[i] + rests[j]) ** 2
    v = np.zeros((size, size))
    for i in range(size):
        v[i, i] = alone[i] / n**3
    for (i, j), value in both.items():
        v[i, j] = v[j, i] = (value - alone[i] - alone[j]) / (2 * n**3)
    return v


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def fit(vectors: DataFrame, dimensions: int, p: WhitenParameters) -> Whitening | None:
    """Two passes over the column ``v`` of ``vectors``; None without rows."""

    def sums(batches: Iterable[pa.RecordBatch], mine: list) -> None:
        for part, x in parts(batches, 0, dimensions, p):
            mine[dimensions] += part.num_rows
            mine[:dimensions] = [a + b for a, b in zip(mine, column_sums(x))]

    *total, n = totals(vectors.select("v"), dimensions + 1, sums)
    if not n:
        return None
    floors = [s // n for s in total]
    rests = [s - n * f for s, f in zip(total, floors)]
    below = np.array(floors, dtype=np.int64)

    def squares(batches: Iterable[pa.RecordBatch], mine: list) -> None:
        for _, x in parts(batches, 0, dimensions, p):
            mine[:] = [a + b for a, b in zip(mine, pair_squares(x - below))]

    v = covariance(n, rests, totals(vectors.select("v"), dimensions * (dimensions + 1) // 2, squares))
    value, axis = np.linalg.eigh(v)
    order = [k for k in np.argsort(-value, kind="stable") if value[k] > dimensions * np.finfo(float).eps * value.max()]
    order = order[: p.components]
    trace = float(np.trace(v))
    return Whitening(n, floors, rests, axis[:, order].T.tolist(), value[order].tolist(), [float(value[k]) / trace for k in order])


def projected(vectors: DataFrame, key: str, dimensions: int, w: Whitening, p: WhitenParameters) -> DataFrame:
    """``key, deviation, w`` for every vector: its exact squared distance from the mean, times n**2, and its whitened coordinates."""
    schema = StructType([vectors.schema[key], *StructType.fromDDL("deviation decimal(38,0), w array<double>").fields])
    arrow = to_arrow_schema(schema)
    below, rests = np.array(w.floors, dtype=np.int64), np.array(w.rests, dtype=object)
    axes = np.array(w.axes) / np.sqrt(np.array(w.eigenvalues))[:, None]
    rest = np.array([r / w.n for r in w.rests])
    most_rest, square_rests = max(w.rests), sum(r * r for r in w.rests)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in parts(batches, 1, dimensions, p):
            d = x - below
            most = int(np.abs(d).max(initial=0))
            small = max(most * most, most * most_rest) * dimensions < INT64
            whole = d if small else d.astype(object)
            own, mixed = (whole * whole).sum(axis=1), (whole * (rests.astype(np.int64) if small else rests)).sum(axis=1)
            # Of (n * d - rest) squared.
            deviation = [w.n * w.n * a - 2 * w.n * b + square_rests for a, b in zip(own.tolist(), mixed.tolist())]
            out = (d - rest) @ axes.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            columns = [part.column(0), pa.array([Decimal(v) for v in deviation], arrow[1].type), lists.cast(arrow[2].type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return vectors.select(key, "v").mapInArrow(run, schema)


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of the column ``w`` minus the identity; centred, then multiplied."""

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)

    def sums(batches: Iterable[pa.RecordBatch], mine: list) -> None:
        for w in values(batches):
            mine[:] = [a + b for a, b in zip(mine, w.sum(axis=0).tolist())]

    mean = np.array(totals(rows.select("w"), components, sums, "double")) / n

    def products(batches: Iterable[pa.RecordBatch], mine: list) -> None:
        for w in values(batches):
            centred = w - mean
            mine[:] = [a + b for a, b in zip(mine, (centred.T @ centred).ravel().tolist())]

    covariances = np.array(totals(rows.select("w"), components * components, products, "double")) / n
    return float(np.abs(covariances.reshape(components, components) - np.eye(components)).max())


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parameters: WhitenParameters = WhitenParameters()) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable vector and component.

    Entries x become the whole numbers ``floor(scale * x) + offset``. Components
    are unit eigenvectors of their covariance (divisor n) by falling eigenvalue,
    numbered from 1; ``whitened`` is the centred vector along the component over
    the root of its eigenvalue, ``explained`` the eigenvalue's share of the
    trace, ``deviation`` the exact sum of (n * x - sum)^2 over the dimensions as
    a decimal, ``identity_error`` the largest deviation of the whitened rows'
    covariance from the identity.

    A vector that is null or empty, or has a null or an entry that isn't finite,
    takes no part; nor does one of another length than most have (the longer,
    where as many have either). Components without variance are left out, so
    equal vectors, or only one, give no rows, like an empty table. Repeated
    vectors and keys and null keys are rows like others. Equal eigenvalues: any
    orthonormal axes, the same for all rows. Other columns take no part,
    whatever their names. An entry beyond 64 bits after scaling is an error.
    """
    p = parameters
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("length")).count()
    dimensions = lengths.agg(F.max_by("length", F.struct("count", "length"))).first()[0]
    result = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    w = None
    if dimensions is not None:
        rows = rows.filter(F.size("v") == dimensions)
        w = fit(rows, dimensions, p)
    if w is None or not w.axes:
        schema = StructType([df.select(F.col(f"`{key}`").alias(key)).schema[0], *StructType.fromDDL(result).fields])
        return df.sparkSession.createDataFrame([], schema)
    done = written(projected(rows, "key", dimensions, w, p))
    error = identity_error(done, w.n, len(w.axes))
    spread = done.select("key", "deviation", F.posexplode("w").alias("place", "whitened"))
    explained = F.array(*[F.lit(e) for e in w.explained])
    return spread.select(
        F.col("key").alias(key), (F.col("place") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
