"""N-gram Jaccard join by chosen paths.

Texts are sets of word n-grams, sketched by minimum hashes. In every run the
sketches are split again and again on sampled shared coordinates: a path is a
sequence of chosen coordinates and their values, and texts that share it stay
together. Buckets are compared pair by pair; what stays large is compared
block against block (``blocks.py``). Runs are repeated until pairs at the threshold are found
with the target recall. Every pair is verified on the full sets.

A pair counts where its smallest shared bucket is, so no pairs have to be
written out to tell repeated finds apart: tasks return the number of links and
one edge to the local component for each text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.blocks import compare, emit_links, emit_members, in_blocks, similar_sets, similar_sketches
from tablevitals.llm.common import carries_its_code, fresh, map_column, written

carries_its_code(__name__)

COORDINATES = 64
WANTED_BROADCAST = 500_000
# Odd multipliers of 64-bit polynomial and mixing hashes.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class JoinParameters:
    similarity: float = 0.8
    words: int = 5
    recall: float = 0.9999  # of pairs at the threshold whose paths are split this often:
    depth: int = 3
    deepest: int = 3  # levels after which a bucket is compared in blocks; near copies don't part on further ones
    bucket: int = 1024  # texts that are compared pair by pair
    seed: int = 10

    @property
    def least(self) -> int:
        """Equal coordinates from which a pair is verified.

        Estimates from 64 coordinates are off by more than five standard deviations once in millions.
        """
        spread = math.sqrt(self.similarity * (1 - self.similarity) / COORDINATES)
        return max(1, math.floor(COORDINATES * (self.similarity - 5 * spread)))

    def missed(self, runs: int) -> float:
        """Share of pairs at the threshold that no run finds.

        All runs choose from the same coordinates, so they are independent only
        given how many of them are equal; that number is binomial.
        """
        total = 0.0
        for equal in range(COORDINATES + 1):
            share = math.comb(COORDINATES, equal) * self.similarity**equal * (1 - self.similarity) ** (COORDINATES - equal)
            # A level chooses one coordinate, and with 1/similarity - 1 another.
            apart, second = 1 - equal / COORDINATES, 1 / self.similarity - 1
            together = 1 - (1 - second) * apart - second * apart * apart
            total += share * ((1 - together**self.depth) ** runs if equal >= self.least else 1.0)
        return total

    @property
    def runs(self) -> int:
        most = 1 - self.recall
        if self.missed(1_000_000) > most:
            raise ValueError(f"a recall of {self.recall} needs more than {COORDINATES} coordinates")
        runs = 1
        while self.missed(runs) > most:
            runs += 1
        return runs


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes, computed over the bytes of a whole text at once."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            steps = np.full(n - 1, BASE, dtype=np.uint64)
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(steps)])
            steps[:] = pow(BASE, -1, 2**64)
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(steps)])

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.hashes(text))

    def hashes(self, text: str) -> np.ndarray:
        """One hash for each place of a gram, in the order of the text."""
        return self.hashes_of(text.encode())

    def hashes_of(self, utf8: bytes) -> np.ndarray:
        data = np.frombuffer(utf8, dtype=np.uint8)
        inside = ~SPACES[data]
        if not inside.any():
            return np.zeros(0, dtype=np.uint64)
        border = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            border = np.concatenate([[0], border])
        start, end = border[::2], border[1::2]
        if inside[-1]:
            end = np.concatenate([end, [len(data)]])
        self.grow(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        word = mixed((total[end] - total[start]) * self.inverse[start])
        n = min(self.words, len(word))
        gram = np.zeros(len(word) - n + 1, dtype=np.uint64)
        for i in range(n):
            gram *= np.uint64(BASE)
            gram += word[i : len(word) - n + 1 + i]
        return mixed(gram)


def sketcher(p: JoinParameters) -> Callable[[str], bytes | None]:
    """A function from text to its minimum hashes; None for a text without words."""
    rng = np.random.default_rng(p.seed)
    factor = (rng.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    shift = rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]
    shingles = Shingler(p.words)

    def sketch(text: str) -> bytes | None:
        grams = shingles.hashes(text)
        if not len(grams):
            return None
        low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(grams), 4096):
            part = (grams[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
            np.minimum(low, (part * factor + shift).min(axis=1), out=low)
        return low.tobytes()

    return sketch


def split(rows: DataFrame, p: JoinParameters) -> DataFrame:
    """``u, path`` one level down for rows of ``u, sketch, path``; the path alone chooses the coordinates."""
    second = int((1 / p.similarity - 1) * 2**16)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, COORDINATES)
            path = batch.column(2).to_numpy().view(np.uint64)
            choice = mixed(path + np.uint64(p.seed))
            u = batch.column(0)
            one, two = (((choice >> np.uint64(shift)) % np.uint64(COORDINATES)).astype(np.int64) for shift in (0, 16))
            # The same coordinate twice would put every text into the same bucket twice.
            again = np.flatnonzero(((choice >> np.uint64(48)) < second) & (two != one))
            for at, take in ((one, np.arange(n)), (two, again)):
                at = at[take]
                value = sketch[take, at].astype(np.uint64)
                key = mixed(mixed(path[take] * np.uint64(BASE) + at.astype(np.uint64) + np.uint64(1)) ^ value)
                yield pa.RecordBatch.from_arrays([u.take(pa.array(take)), pa.array(key.view(np.int64))], names=["u", "path"])

    return rows.select("u", "sketch", "path").mapInArrow(run, "u binary, path long")


def leaves(sketches: DataFrame, p: JoinParameters) -> DataFrame:
    """``path, u, size`` of all buckets of two or more texts; buckets with the same texts only once."""
    starts = F.transform(F.sequence(F.lit(1), F.lit(p.runs)), lambda r: F.xxhash64(F.lit(p.seed), r))
    level = split(sketches.withColumn("path", F.explode(starts)), p)
    found = None
    for depth in range(1, p.deepest + 1):
        level = written(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        kept = written(level.join(sizes, "path"))
        small = kept if depth == p.deepest else kept.filter(F.col("size") <= p.bucket)
        found = small if found is None else found.unionByName(small)
        large = kept.filter(F.col("size") > p.bucket)
        if depth == p.deepest or large.isEmpty():
            break
        level = split(large.join(sketches, "u"), p)
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "u")) for i in (0, 1)]
    buckets = found.groupBy("path").agg(F.count("*").alias("n"), marks[0].alias("a"), marks[1].alias("b"))
    # Marks tell sets of texts apart as no text is in a bucket twice.
    single = buckets.groupBy("n", "a", "b").agg(F.min("path").alias("path")).select("path")
    return written(found.join(single, "path"))


def components(edges: DataFrame) -> DataFrame:
    """``u, root``: the smallest node of each component of ``edges (a, b)``, by alternating large and small stars."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # Large star: larger neighbours of a node are tied to its smallest neighbour.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself are tied to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(tied.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            return edges.select(F.col("a").alias("u"), F.col("b").alias("root"))
        state = now


def text_key(text: Column | str) -> Column:
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def text_classes(df: DataFrame, text: str, p: JoinParameters, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``u`` (hash of the text) and without the text, and ``u, root, n_links`` of the different texts."""
    sketch = sketcher(p)

    def start() -> Callable[[list], list]:
        return lambda texts: [[None if t is None else sketch(t) for t in texts]]

    rows = written(map_column(df.select(F.col(key).alias("key"), F.col(text).alias("t"), text_key(text).alias("u")), "t",
                              "sketch binary", start).drop("t"))
    texts = rows.filter("sketch IS NOT NULL").select("u", "sketch").dropDuplicates(["u"])
    texts = written(texts)
    found = leaves(texts, p)
    shared = written(found.groupBy("u").agg(F.array_distinct(F.collect_list("path")).alias("shared")))
    blocked = in_blocks(found.distinct().withColumn("size", F.lit(4 * COORDINATES)))
    members = compare(blocked, shared.join(texts, "u"), "sketch", similar_sketches(p.least), emit_members, "path long, u binary")
    members = written(members.distinct())
    wanted = written(members.select("u").distinct())
    # Hashes of 16 bytes: few enough go to all tasks, so that other texts stay where they are; more are joined by shuffle.
    if wanted.count() <= WANTED_BROADCAST:
        wanted = F.broadcast(wanted)
    shingles = Shingler(p.words)

    def start_sets() -> Callable[[list], list]:
        return lambda values: [[shingles(v).tobytes() for v in values]]

    whole = df.select(text_key(text).alias("u"), F.col(text).alias("t")).join(wanted, "u", "left_semi").dropDuplicates(["u"])
    sets = written(map_column(whole, "t", "grams binary", start_sets, drops=True).drop("t").withColumn("size", F.octet_length("grams")))
    blocked = written(in_blocks(members.join(sets.select("u", "size"), "u")))
    share = Fraction(p.similarity).limit_denominator(10**6)
    judge = similar_sets(share.numerator, share.denominator)
    exact = compare(blocked, shared.join(sets.select("u", "grams"), "u"), "grams", judge, emit_links, "u binary, links long, root binary")
    links = written(exact)
    roots = components(links.select(F.col("u").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("u").agg(F.sum("links").alias("n_links"))
    return rows, counts.join(roots, "u", "left").select("u", F.coalesce("root", "u").alias("root"), "n_links")


def jaccard_join(df: DataFrame, parameters: JoinParameters = JoinParameters(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, class_id, n_links, n_copies`` for every row: its near-duplicate class, links and exact copies.

    ``class_id`` is the smallest key of the class, the texts that links join
    directly or through others; ``n_links`` the number of different texts with
    at least the given Jaccard similarity; ``n_copies`` the rows with the very
    same text. Texts without words are linked to none but share a class with
    equal texts; a null text is a class of its own with its key. Texts of fewer
    words than the n-gram are one gram. A null key is never the class's
    unless all are null. Repeated rows stay; an empty table gives no rows. Other
    columns take no part and are not returned, whatever their names.
    """
    rows, linked = text_classes(df, text, parameters, key)
    (name,) = [key]
    copies = rows.filter("u IS NOT NULL").groupBy("u").agg(F.min("key").alias("least"), F.count("*").alias("n_copies"))
    classes = copies.join(linked, "u", "left").withColumn("root", F.coalesce("root", "u"))
    lowest = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.join(lowest, "root").select("u", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.join(classes, "u", "left").select(
        F.col("key").alias(name),
        F.when(F.col("u").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each_class(df: DataFrame, parameters: JoinParameters = JoinParameters(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` with the smallest key of each class; of several such rows one, of null texts all.

    Rows with empty texts, or texts without words, form a class for each text.
    An empty table gives no rows; all columns are returned, whatever their names.
    The chosen (key, text) pairs are found on keys and hashes alone; texts are
    read once more for the result, and shuffled only where a chosen pair repeats.
    """
    rows, linked = text_classes(df, text, parameters, key)
    rows = rows.filter("u IS NOT NULL").groupBy("u", "key").agg(F.count("*").alias("n"))
    classed = rows.join(linked.select("u", "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    order = F.struct(F.col("key").isNull().alias("k"), F.col("key"), F.col("u"))
    chosen = classed.groupBy("root").agg(F.min_by(F.struct("u", "key", "n"), order).alias("c")).select("c.u", "c.key", "c.n")
    chosen = written(chosen)
    (hashed,) = fresh(df, "text_hash")
    signed = df.withColumn(hashed, text_key(text))

    def those(which: DataFrame) -> DataFrame:
        same = (signed[hashed] == which["u"]) & signed[key].eqNullSafe(which["key"])
        return signed.join(which, same, "left_semi")

    once = those(chosen.filter("n = 1"))
    repeated = those(chosen.filter("n > 1")).dropDuplicates([hashed, key])
    nulls = signed.filter(F.col(text).isNull())
    return once.unionByName(repeated).unionByName(nulls).drop(hashed)
