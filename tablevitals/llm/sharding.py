"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every input partition draws how many of its rows go to each shard, such that
the row sums are the partition sizes and the column sums the shard sizes; its
rows are dealt out by a random permutation of these destinations; after the
exchange every shard is permuted again. Every assignment of rows to places is
then equally likely (Sanders 1998), and only one exchange is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablevitals.llm.common import carries_its_code, fresh, written

carries_its_code(__name__)

# Numpy draws up to this population; larger ones use the ratio of uniforms below.
NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones among ``sample`` drawn from ``good + bad`` without putting back."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    log_f = math.lgamma

    def log_weight(k: int) -> float:
        return -(log_f(k + 1) + log_f(good - k + 1) + log_f(sample - k + 1) + log_f(bad - sample + k + 1))

    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, ((sample + 1) * (good + 1)) // (total + 2)))
    spread = sample * good / total * (bad / total) * ((total - sample) / (total - 1))
    # Ratio of uniforms: width sqrt(2 / e) * sd, with the usual allowance for discreteness.
    width, top = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 0.9, log_weight(mode)
    centre = sample * good / total + 0.5
    while True:
        u = 1.0 - rng.random()
        k = math.floor(centre + width * (rng.random() - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_weight(k) - top:
            return k


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows for each (partition, shard) with both margins as given, as a random shuffle would make them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    room = list(shard_rows)
    matrix = []
    for rows in partition_rows:
        left, free, drawn = rows, sum(room), []
        for shard, capacity in enumerate(room):
            free -= capacity
            take = hypergeometric(rng, capacity, free, left)
            drawn.append(take)
            left -= take
            room[shard] -= take
        matrix.append(drawn)
    return matrix


def shard_uniformly(df: DataFrame, shards: int, seed: int = 7, rows_per_block: int = 250_000) -> DataFrame:
    """All rows of ``df`` with ``shard`` (from 0) and ``slot`` (0, 1, … without gaps in each shard).

    Shard sizes differ by at most one; the first shards take the surplus.
    Rows are first written to the shared folder, which fixes partitions and the
    rows' numbers, so a repeated task deals its rows out as before. The driver
    holds one count per partition and shard. After the exchange a shard is
    ordered in blocks of about ``rows_per_block`` rows, so no task holds a shard.

    Repeated rows are separate rows; nulls and empty texts make no difference.
    An empty table gives no rows. Columns called ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot")
    row, at, block, order = fresh(df, "row_number", "partition_number", "shard_block", "random_order")
    base = written(df.withColumn(at, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    base = base.withColumn(at, F.spark_partition_id())
    counts = {r[0]: r[1] for r in base.groupBy(at).count().collect()}
    places = sorted(counts)
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in places], sizes, seed)
    dealt = dict(zip(places, matrix))
    number_at = base.columns.index(at)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, left = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if left is None:
                place = batch.column(number_at)[0].as_py()
                rng = np.random.Generator(np.random.PCG64([seed, place]))
                left = np.array(dealt[place], dtype=np.int64)
            # Permuting all destinations and cutting the result into batches gives batch counts
            # that are hypergeometric themselves, so no partition has to be held whole.
            mine, n = np.zeros_like(left), batch.num_rows
            rest, after = n, int(left.sum())
            for s, capacity in enumerate(left.tolist()):
                after -= capacity
                mine[s] = hypergeometric(rng, capacity, after, rest)
                rest -= mine[s]
            left -= mine
            shard = rng.permutation(np.repeat(np.arange(len(left), dtype=np.int32), mine))
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(shard)], names=batch.schema.names + ["shard"])

    assigned = base.mapInArrow(deal, T.StructType(base.schema.fields + [T.StructField("shard", T.IntegerType())]))
    # One order for both uses: its leading part names the block, the rest places rows inside it.
    blocks = max(1, math.ceil((sizes[0] if sizes else 0) / rows_per_block))
    assigned = written(
        assigned.withColumn(order, F.xxhash64(F.lit(seed), F.col(row))).withColumn(
            block, F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * blocks).cast("int")
        )
    )
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    (offset,) = fresh(assigned, "block_offset")
    offsets = (
        assigned.groupBy("shard", block)
        .count()
        .select("shard", block, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    )
    inside = Window.partitionBy("shard", block).orderBy(order, row)
    return (
        assigned.withColumn("slot", F.row_number().over(inside) - 1)
        .join(offsets if blocks * shards > 100_000 else F.broadcast(offsets), ["shard", block])
        .withColumn("slot", F.col("slot").cast("long") + F.col(offset))
        .select(*df.columns, "shard", "slot")
    )

