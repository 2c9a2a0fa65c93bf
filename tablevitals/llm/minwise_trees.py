"""Near duplicates by a chosen-path similarity join over trees of minwise tokens.

A document is the set of its word shingles. Every tree sends the documents
down from its root: a node chooses one or two of its level's minwise functions,
and a document goes to the child named by its smallest token under each. With
``1 / similarity`` children on average, a pair at the threshold is expected to
stay together at one place of every level, while unlike documents part. A small
node is compared exhaustively, and so is one that is still large at the lowest
level, block against block. Trees use functions of their own and are repeated
until a pair at the threshold is missed by all of them with the target
probability only. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.blocks import compare, emit_links, emit_members, in_blocks, similar_sets, similar_sketches
from tablevitals.llm.chosen_path import WANTED_BROADCAST, Shingler, components, mixed, text_key
from tablevitals.llm.common import carries_its_code, map_column, written

carries_its_code(__name__)

# Minwise functions that a level of a tree chooses from.
CHOICES = 2


@dataclass(frozen=True)
class TreeParameters:
    numerator: int = 85  # documents are linked from numerator / denominator on
    denominator: int = 100
    words: int = 5
    recall: float = 0.9999  # of pairs at the threshold whose nodes reach the lowest level
    depth: int = 3
    node: int = 1024  # documents that are compared without branching on
    seed: int = 13

    @property
    def similarity(self) -> float:
        return self.numerator / self.denominator

    @property
    def found_by_tree(self) -> float:
        """Chance that a pair at the threshold shares a node of the lowest level, over which tokens are equal."""
        second, cells, total = 1 / self.similarity - 1, self.depth * CHOICES, 0.0
        for equal in itertools.product((0, 1), repeat=cells):
            below = 1.0
            for level in reversed(range(self.depth)):
                here = equal[CHOICES * level : CHOICES * (level + 1)]
                lost = [(1 - here[f] * below) * (1 - second * here[1 - f] * below) for f in range(CHOICES)]
                below = 1 - sum(lost) / CHOICES
            total += below * self.similarity ** sum(equal) * (1 - self.similarity) ** (cells - sum(equal))
        return total

    @property
    def trees(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - self.found_by_tree)))

    @property
    def coordinates(self) -> int:
        return self.trees * self.depth * CHOICES

    @property
    def least(self) -> int:
        """Equal tokens from which a pair's full sets are compared: five standard deviations below the threshold."""
        spread = math.sqrt(self.similarity * (1 - self.similarity) / self.coordinates)
        return max(1, math.floor(self.coordinates * (self.similarity - 5 * spread)))


def gram_set(text: str | None, shingles: Shingler) -> np.ndarray:
    """The sorted different shingles of a text; ``bytes.lower`` changes A-Z only."""
    grams = np.sort(shingles.hashes_of((text or "").encode().lower()))
    return grams[np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))] if len(grams) else grams


def set_key(grams: np.ndarray) -> bytes:
    """A hash of a whole set, equal for equal sets."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def set_reader(p: TreeParameters) -> Callable[[str | None], tuple[bytes | None, int, bytes | None]]:
    """A function from text to its set's key, size and minwise tokens; no key for a text without words."""
    rng, coordinates = np.random.default_rng(p.seed), p.coordinates
    factor = (rng.integers(0, 2**31, coordinates, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    shift = rng.integers(0, 2**32, coordinates, dtype=np.uint32)[:, None]
    shingles = Shingler(p.words)

    def read(text: str | None) -> tuple[bytes | None, int, bytes | None]:
        grams = gram_set(text, shingles)
        if not len(grams):
            return None, 0, None
        low = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(grams), 4096):
            part = (grams[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
            np.minimum(low, (part * factor + shift).min(axis=1), out=low)
        return set_key(grams), len(grams), low.tobytes()

    return read


def branch(rows: DataFrame, level: int, p: TreeParameters) -> DataFrame:
    """``u, tree, path`` of the children for rows of ``u, tokens, tree, path``; the path alone chooses the functions."""
    second, coordinates = int((1 / p.similarity - 1) * 2**16), p.coordinates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, coordinates)
            tree, path = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            choice = mixed(path + np.uint64(p.seed))
            first = (choice & np.uint64(1)).astype(np.int64)
            again = np.flatnonzero((choice >> np.uint64(48)) < second)
            for function, take in ((first, np.arange(n)), (1 - first, again)):
                at = (tree[take].astype(np.int64) * p.depth + level) * CHOICES + function[take]
                value = tokens[take, at].astype(np.uint64)
                child = mixed(mixed(path[take] + at.astype(np.uint64) + np.uint64(1)) ^ value)
                rows = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(child.view(np.int64))], names=["u", "tree", "path"]
                )

    return rows.select("u", "tokens", "tree", "path").mapInArrow(run, "u binary, tree int, path long")


def nodes(sets: DataFrame, p: TreeParameters) -> DataFrame:
    """``path, u`` of all nodes to compare; of nodes with the same documents one."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(p.trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(p.seed), t).alias("path")))
    here = sets.select("u", "tokens", F.inline(roots))
    found = None
    for level in range(p.depth):
        children = written(branch(here, level, p))
        sizes = children.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        kept = written(children.join(sizes, "path"))
        last = level == p.depth - 1
        small = kept if last else kept.filter(F.col("size") <= p.node)
        found = small if found is None else found.unionByName(small)
        large = kept.filter(F.col("size") > p.node)
        if last or large.isEmpty():
            break
        here = large.join(sets, "u")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "u")) for i in (0, 1)]
    same = found.groupBy("path").agg(F.count("*").alias("n"), marks[0].alias("a"), marks[1].alias("b"))
    one = same.groupBy("n", "a", "b").agg(F.min("path").alias("path")).select("path")
    return written(found.join(one, "path").select("path", "u"))


def near_duplicates(df: DataFrame, parameters: TreeParameters = TreeParameters(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Rows are linked where the intersection of their shingle sets is at least
    ``numerator / denominator`` of the union; A-Z count as a-z. ``n_shingles``
    is the size of the set, ``component_id`` the smallest key that links reach,
    the row's own included, ``kept`` whether that is the row's own. A text of
    fewer words than a shingle is one shingle; a null or empty text, or one
    without words, has none and is linked with nothing, not even its equals.
    Rows with equal sets are one node of the search and always linked.
    Repeated rows and rows with the same key stay rows: those with the smallest
    key are all kept. A null key counts as larger than all others; in a
    component of null keys only, ``component_id`` is null and all are kept. An
    empty table gives no rows; other columns take no part, whatever their names.
    """
    p = parameters
    read = set_reader(p)

    def start() -> Callable[[list], list]:
        return lambda texts: list(zip(*map(read, texts))) or [[], [], []]

    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"), text_key(F.col(f"`{text}`")).alias("text_hash"))
    rows = written(map_column(source, "t", "u binary, n_shingles long, tokens binary", start).drop("t"))
    sets = rows.filter("u IS NOT NULL").groupBy("u").agg(F.min_by(F.struct("tokens", "text_hash"), "text_hash").alias("s"))
    sets = written(sets.select("u", "s.tokens", "s.text_hash"))
    found = nodes(sets, p)
    shared = written(found.groupBy("u").agg(F.array_distinct(F.collect_list("path")).alias("shared")))
    blocked = in_blocks(found.withColumn("size", F.lit(4 * p.coordinates)))
    about = shared.join(sets.select("u", "tokens"), "u")
    members = written(compare(blocked, about, "tokens", similar_sketches(p.least), emit_members, "path long, u binary").distinct())
    wanted = written(members.select("u").distinct().join(sets.select("u", "text_hash"), "u").select("text_hash"))
    # As in every step on texts: few hashes of 16 bytes go to all tasks, more are joined by shuffle.
    if wanted.count() <= WANTED_BROADCAST:
        wanted = F.broadcast(wanted)

    def start_sets() -> Callable[[list], list]:
        shingles = Shingler(p.words)

        def read_sets(texts: list) -> list:
            grams = [gram_set(t, shingles) for t in texts]
            return [[set_key(g) for g in grams], [g.tobytes() for g in grams]]

        return read_sets

    whole = source.select("text_hash", "t").join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    grams = written(map_column(whole.select("t"), "t", "u binary, grams binary", start_sets).drop("t").withColumn("size", F.octet_length("grams")))
    blocked = written(in_blocks(members.join(grams.select("u", "size"), "u")))
    judge = similar_sets(p.numerator, p.denominator)
    links = written(compare(blocked, shared.join(grams.select("u", "grams"), "u"), "grams", judge, emit_links, "u binary, links long, root binary"))
    reached = components(links.select(F.col("u").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "reached")
    least = rows.filter("u IS NOT NULL").groupBy("u").agg(F.min("key").alias("least"))
    classes = least.join(reached, "u", "left").withColumn("reached", F.coalesce("reached", "u"))
    lowest = classes.groupBy("reached").agg(F.min("least").alias("component_id"))
    component = classes.join(lowest, "reached").select("u", "component_id")
    own = F.col("key")
    joined = rows.select("key", "u", "n_shingles").join(component, "u", "left")
    joined = joined.withColumn("component_id", F.when(F.col("u").isNull(), own).otherwise(F.col("component_id")))
    return joined.select(own.alias(key), "n_shingles", "component_id", own.eqNullSafe(F.col("component_id")).alias("kept"))
