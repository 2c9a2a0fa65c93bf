"""Comparing all pairs inside buckets of any size, block against block.

A bucket's texts are packed into rows of one block each, a bounded number of
texts and bytes. A bucket of one block is one row and one task. In a larger one
every block meets every other once, as packed rows: with blocks of 2048 texts a
bucket of G texts makes (G / 2048)^2 / 2 pairs of rows, so neither rows nor joins
grow with the pairs of texts, and no text is left out however large its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import carries_its_code

carries_its_code(__name__)

BLOCK_TEXTS = 2048
BLOCK_BYTES = 8 << 20
# Cells of the tables that a task multiplies at a time.
TABLE_CELLS = 4_000_000
# Rows of a matrix of pairs that are looked at a time.
SLICE = 512


def in_blocks(found: DataFrame, texts: int = BLOCK_TEXTS, octets: int = BLOCK_BYTES) -> DataFrame:
    """``path, u, blocks`` of buckets of two or more texts, from ``path, u, size``, the bytes of the text's payload."""
    sizes = found.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("octets")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(texts), F.col("octets") / F.lit(octets), F.lit(1.0))).cast("int")
    return found.select("path", "u").join(sizes.select("path", blocks.alias("blocks")), "path")


def packed(found: DataFrame, about: DataFrame, payload: str) -> DataFrame:
    """One row for each block: ``path, blocks, block`` and the arrays ``u, shared, payload``.

    ``found`` has ``path, u, blocks``, ``about`` one row ``u, shared, <payload>`` for each text.
    """
    item = F.struct("u", "shared", F.col(payload).alias("payload"))
    block = F.pmod(F.xxhash64(F.lit(7), "u"), F.col("blocks")).cast("int")
    rows = found.join(about, "u").groupBy("path", "blocks", block.alias("block")).agg(F.collect_list(item).alias("items"))
    return rows.select("path", "blocks", "block", "items.u", "items.shared", F.col("items.payload").alias("payload"))


def compare(found: DataFrame, about: DataFrame, payload: str, judge: Callable, emit: Callable, schema: str) -> DataFrame:
    """Runs ``judge`` on every block with itself, and on every two blocks of one bucket.

    ``judge(left, right)`` gives the matrix of similar pairs of two lists of
    payloads (``right`` None: of the left with itself), ``emit(path, left,
    right, similar, same)`` the rows for the keys of both sides. A pair that
    shares a smaller path is left to that, so that every pair counts once.
    """

    def group(path: int, left: list, right: list | None) -> pa.RecordBatch | None:
        if right is None and len(left[0]) < 2:
            return None
        similar = judge(left[2], None if right is None else right[2])
        if right is None:
            np.fill_diagonal(similar, False)
        if not similar.any():
            return None
        at = np.flatnonzero(similar.any(axis=1)), np.flatnonzero(similar.any(axis=0))
        sides = left, left if right is None else right
        similar = similar[np.ix_(*at)]
        number: dict[int, int] = {}
        marks = []
        for keep, side in zip(at, sides):
            marks.append([(row, number.setdefault(p, len(number))) for row, k in enumerate(keep.tolist()) for p in side[1][k] if p < path])
        if all(marks):
            marks = [np.array(cells) for cells in marks]
            for low in range(0, len(number), SLICE):
                tables = [np.zeros((len(keep), SLICE), dtype=np.float32) for keep in at]
                for table, cells in zip(tables, marks):
                    part = cells[(cells[:, 1] >= low) & (cells[:, 1] < low + SLICE)]
                    table[part[:, 0], part[:, 1] - low] = 1
                similar &= tables[0] @ tables[1].T == 0
        keys = [[side[0][k] for k in keep.tolist()] for keep, side in zip(at, sides)]
        return emit(path, *keys, similar, right is None) if similar.any() else None

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, *side = (batch.column(c)[k].as_py() for c in range(4))
                if (result := group(path, side, None)) is not None:
                    yield result

    def meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list = []  # the row of the pair of blocks that came first
        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in range(3))
                side = [batch.column(c)[k].as_py() for c in range(4, 7)]
                if before and before[0] == key:
                    if (result := group(key[0], before[1], side)) is not None:
                        yield result
                    before = []
                else:
                    before = [key, side]

    columns = ["u", "shared", "payload"]
    result = packed(found, about, payload).select("path", *columns).mapInArrow(alone, schema)
    large = found.filter("blocks > 1")
    if large.isEmpty():
        return result
    rows = packed(large, about, payload).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows.filter("other <> block").select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    dealt = pairs.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "block")
    return result.unionByName(dealt.mapInArrow(meeting, schema))


def similar_sets(numerator: int, denominator: int) -> Callable:
    """A judge of sets, given as sorted 64-bit numbers: denominator * intersection >= numerator * union."""

    def judge(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        sides = [[np.frombuffer(v, dtype=np.uint64) for v in side] for side in ((left,) if right is None else (left, right))]
        size = [np.array([len(s) for s in side], dtype=np.int64) for side in sides]
        grams, at = np.unique(np.concatenate([s for side in sides for s in side]), return_inverse=True)
        wanted = np.bincount(at, minlength=len(grams)) > 1
        cut = int(size[0].sum())
        number = np.cumsum(wanted) - 1
        tables = []
        for part, lengths in zip((at[:cut], at[cut:]), size):
            owner = np.repeat(np.arange(len(lengths)), lengths)
            keep = wanted[part]
            part, owner = number[part[keep]], owner[keep]
            order = np.argsort(part, kind="stable")
            tables.append((part[order], owner[order], len(lengths)))
        # Whole numbers up to 2**24 are exact in 32 bits.
        both = np.zeros((len(size[0]), len(size[-1])), dtype=np.float32 if max(s.max() for s in size) < 2**24 else np.float64)
        together = int(wanted.sum())
        width = min(together, max(64, TABLE_CELLS // max(both.shape)))
        for low in range(0, together, width or 1):
            dense = []
            for part, owner, n in tables:
                a, b = np.searchsorted(part, [low, low + width])
                table = np.zeros((n, width), dtype=np.float32)
                table[owner[a:b], part[a:b] - low] = 1
                dense.append(table)
            both += dense[0] @ dense[-1].T
        similar = np.zeros(both.shape, dtype=bool)
        for low in range(0, len(both), SLICE):
            part = both[low : low + SLICE].astype(np.int64)
            union = size[0][low : low + SLICE, None] + size[-1][None, :] - part
            similar[low : low + SLICE] = denominator * part >= numerator * union
        return similar

    return judge


def similar_sketches(least: int) -> Callable:
    """A judge of sketches: at least so many equal 32-bit coordinates (of at most 255)."""

    def judge(left: list[bytes], right: list[bytes] | None) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(side), dtype=np.uint32).reshape(len(side), -1) for side in (left, left if right is None else right))
        equal = np.zeros((len(a), len(b)), dtype=np.uint8)
        for one, two in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
            equal += one[:, None] == two[None, :]
        return equal >= least

    return judge


def emit_members(path: int, left: list, right: list, similar: np.ndarray, same: bool) -> pa.RecordBatch:
    """``path, u`` of all texts of a similar pair."""
    who = [u for keys, axis in ((left, 1), (right, 0)) for u, any_ in zip(keys, similar.any(axis=axis)) if any_]
    who = list(dict.fromkeys(who))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(who), path)), pa.array(who, pa.binary())], names=["path", "u"])


def emit_links(path: int, left: list, right: list, similar: np.ndarray, same: bool) -> pa.RecordBatch:
    """``u, links, root``: the links of every text, and the smallest key that these links join it with."""
    order = {u: k for k, u in enumerate(sorted({*left, *right}))}
    names = sorted(order)
    label = [np.array([order[u] for u in side]) for side in (left, right)]
    label = [x.astype(np.int32) for x in label]
    while True:
        first, second = label[0].copy(), label[1].copy()
        for low in range(0, len(first), SLICE):
            part = similar[low : low + SLICE]
            near = np.where(part, second[None, :], len(names)).min(axis=1)
            first[low : low + SLICE] = np.minimum(first[low : low + SLICE], near)
            near = np.where(part, first[low : low + SLICE, None], len(names)).min(axis=0)
            second = np.minimum(second, near).astype(np.int32)
        if same:
            first = second = np.minimum(first, second)
        if (first == label[0]).all() and (second == label[1]).all():
            break
        label = [first, second]
    links: dict[bytes, int] = {}
    roots: dict[bytes, int] = {}
    for keys, lab, count in ((left, label[0], similar.sum(axis=1)), (right, label[1], similar.sum(axis=0)))[: 1 if same else 2]:
        for u, k, n in zip(keys, lab.tolist(), count.tolist()):
            if n:
                links[u] = links.get(u, 0) + n
                roots[u] = k
    return pa.RecordBatch.from_arrays(
        [pa.array(list(links), pa.binary()), pa.array(list(links.values()), pa.int64()), pa.array([names[roots[u]] for u in links], pa.binary())],
        names=["u", "links", "root"],
    )
