"""Exact quantiles of many columns, per group or over the whole table, on one path for groups of any size.

Values are counted first, so a value that fills much of a column is one row.
The counts are dealt by ranges of (group, column, value): a large group spreads
over many tasks, and many small groups share one. A running sum inside a
partition, plus what earlier partitions hold of the group that it begins with,
is the rank of every value. Each partition contributes its two ends to that
prefix sum, which is all that is fetched.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need no copy of the package: functions of this module travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The group of a table that is one group.
WHOLE = ""


def value_counts_by_group(df: DataFrame, columns: dict[str, Column], group: Column | None = None) -> DataFrame:
    """``(g, c, v, n)``: how often each value of each column, by its place, occurs in each group; missing ones not."""
    key = F.lit(WHOLE) if group is None else group.cast("string")
    cells = [F.struct(F.lit(c).alias("c"), value.cast("double").alias("v")) for c, value in enumerate(columns.values())]
    long = df.select(key.alias("g"), F.inline(F.array(*cells))).filter("g is not null and v is not null")
    return long.groupBy("g", "c", "v").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Ends:
    """What a partition holds of its first and last (group, column), and what others hold of these."""

    first: int
    last: int
    before: int = 0
    after: int = 0


def changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Places where a new (group, column) begins, the first row not counted."""
    g, c = table.column("g"), table.column("c")
    new = pc.or_(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)), pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1


def key_of(table: pa.Table | pa.RecordBatch, row: int) -> tuple:
    return table.column("g")[row].as_py(), table.column("c")[row].as_py()


def partition_ends(ordered: DataFrame) -> dict[int, Ends]:
    """The ends of every partition that has rows: two rows a partition reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list = []  # first and last run: key and sum
        for batch in batches:
            if not batch.num_rows:
                continue
            at = changes(batch)
            sums = np.add.reduceat(batch.column("n").to_numpy(), np.concatenate([[0], at]).astype(np.int64))
            own = [(key_of(batch, 0), int(sums[0]))] + ([(key_of(batch, batch.num_rows - 1), int(sums[-1]))] if len(sums) > 1 else [])
            if runs and runs[-1][0] == own[0][0]:
                runs[-1] = (own[0][0], runs[-1][1] + own[0][1])
                own = own[1:]
            runs = (runs + own)[:1] + (runs + own)[1:][-1:]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part] * len(runs), pa.int32()),
                "place": pa.array(range(len(runs)), pa.int32()),
                "g": pa.array([k[0] for k, _ in runs], pa.string()),
                "c": pa.array([k[1] for k, _ in runs], pa.int32()),
                "n": pa.array([n for _, n in runs], pa.int64()),
            }
        )

    parts: dict[int, list] = {}
    for r in sorted(ordered.mapInArrow(run, "part int, place int, g string, c int, n long").collect(), key=lambda r: (r["part"], r["place"])):
        parts.setdefault(r["part"], []).append(((r["g"], r["c"]), r["n"]))
    around = {part: [0, 0] for part in parts}
    for side, order in ((0, list(parts)), (1, list(reversed(parts)))):
        key, total = None, 0
        for part in order:
            near, far = (parts[part][0], parts[part][-1]) if side == 0 else (parts[part][-1], parts[part][0])
            around[part][side] = total if key == near[0] else 0
            total = far[1] + (around[part][side] if len(parts[part]) == 1 else 0)
            key = far[0]
    return {part: Ends(runs[0][1], runs[-1][1], *around[part]) for part, runs in parts.items()}


def at_ranks(ordered: DataFrame, ends: dict[int, Ends], probs: list[float]) -> DataFrame:
    """``(g, c, n, k, x)``: the values at the ranks below (k even) and above (odd) the position of each probability."""

    def decide(table: pa.Table, before: int, after: int) -> Iterator[pa.RecordBatch]:
        start = np.concatenate([[0], changes(table)]).astype(np.int64)
        upto = np.cumsum(table.column("n").to_numpy())
        end = np.append(start[1:], len(upto)) - 1
        below = np.concatenate([[0], upto[end[:-1]]])
        size = upto[end] - below
        total, offset = size.copy(), np.zeros(len(size), np.int64)
        total[0] += before
        total[-1] += after
        offset[0] = before
        g, c, v = (table.column(name) for name in ("g", "c", "v"))
        for k in range(2 * len(probs)):
            position = (total - 1) * probs[k // 2]
            rank = (np.ceil(position) if k % 2 else np.floor(position)).astype(np.int64) - offset
            here = np.flatnonzero((rank >= 0) & (rank < size))
            row = np.searchsorted(upto, below[here] + rank[here], side="right")
            at = pa.array(start[here])
            yield pa.RecordBatch.from_arrays(
                [*(pc.take(x, at).combine_chunks() for x in (g, c)), pa.array(total[here]), pa.array(np.full(len(here), k, np.int32)), pc.take(v, pa.array(row)).combine_chunks()],
                names=["g", "c", "n", "k", "x"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ends.get(TaskContext.get().partitionId(), Ends(0, 0))
        open_: list[pa.RecordBatch] = []  # the last (group, column), which may go on
        firsts = True
        for batch in batches:
            if not batch.num_rows:
                continue
            at = changes(batch)
            if open_ and key_of(open_[0], 0) != key_of(batch, 0):
                at = np.concatenate([[0], at]).astype(np.int64)
            if not len(at):
                open_.append(batch)
                continue
            done = [*open_, batch.slice(0, int(at[-1]))]
            yield from decide(pa.Table.from_batches(done).combine_chunks(), mine.before if firsts else 0, 0)
            open_, firsts = [batch.slice(int(at[-1]))], False
        if open_:
            last = sum(pc.sum(b.column("n")).as_py() for b in open_)
            if last != mine.last:
                raise RuntimeError("the partitions are not those whose ends were summed")
            yield from decide(pa.Table.from_batches(open_).combine_chunks(), mine.before if firsts else 0, mine.after)

    return ordered.mapInArrow(run, "g string, c int, n long, k int, x double")


def quantiles(counts: DataFrame, probs: list[float], keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """``(g, c, n, q)`` of ``(g, c, v, n)``: number of values and, per probability, the quantile between its two neighbours.

    ``keep`` holds a table until its owner lets it go. Both passes read the
    kept partitions; the second makes sure that they are the first's.
    """
    place = ["g", "c", "v"]
    ordered = keep(counts.select("g", "c", "v", "n").repartitionByRange(*place).sortWithinPartitions(*place))
    found = at_ranks(ordered, partition_ends(ordered), probs)
    sides = [F.max(F.when(F.col("k") == k, F.col("x"))).alias(f"x{k}") for k in range(2 * len(probs))]
    result = []
    for i, p in enumerate(probs):
        at, left, right = (F.col("n") - 1) * F.lit(float(p)), F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}")
        between = (F.ceil(at) - at) * left + (at - F.floor(at)) * right
        result.append(F.when(F.floor(at) == F.ceil(at), left).otherwise(between))
    return found.groupBy("g", "c").agg(F.max("n").alias("n"), *sides).select("g", "c", "n", F.array(*result).alias("q"))


def from_center(counts: DataFrame, centers: DataFrame, few: bool) -> DataFrame:
    """``(g, c, v, n)`` with the distances from ``centers (g, c, center)``; groups without a center fall out."""
    centers = centers.filter("center is not null")
    joined = counts.join(F.broadcast(centers) if few else centers, ["g", "c"])
    return joined.select("g", "c", F.abs(F.col("v") - F.col("center")).alias("v"), "n")


def by_group(table: DataFrame, figures: list[str], columns: int) -> DataFrame:
    """``(g, c, ...)`` with one row for each group: every figure as ``<figure>_<c>``."""
    wide = [F.max(F.when(F.col("c") == c, F.col(f))).alias(f"{f}_{c}") for c in range(columns) for f in figures]
    return table.groupBy("g").agg(*wide)

