"""Exact top-k inner products by branch and bound over a ball tree for each shard.

Vectors are dealt to shards; every shard builds a ball tree. For a block of
queries, nodes are visited in the order of their upper bounds on the inner
product, and a node is left out when its bound is below the query's current
k-th score. That score is shared: each query first searches one shard, and what
it finds there bounds its search in all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.llm.common import carries_its_code, written

carries_its_code(__name__)

LEAF = 128
# Up to these sums of products, double and 64-bit arithmetic on whole numbers are exact; Python's integers are beyond.
EXACT, EXACT_64 = 2.0**53, 2.0**62


class BallTree:
    """Nodes as arrays over rows that are reordered so that every node is a range."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.low, self.high, self.left, self.right = [], [], [], []
        centres, radii = [], []

        def build(low: int, high: int) -> int:
            node = len(self.low)
            rows = vectors[order[low:high]].astype(np.float64)
            centre = rows.mean(axis=0)
            off = rows - centre
            centres.append(centre)
            radii.append(float(np.sqrt((off * off).sum(axis=1).max())))
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            if high - low > leaf and radii[-1] > 0:
                # Split at the median along the line between two far points.
                one = rows[(off * off).sum(axis=1).argmax()]
                gap = rows - one
                other = rows[(gap * gap).sum(axis=1).argmax()]
                middle = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(rows @ (other - one), middle)]
                left = build(low, low + middle)
                right = build(low + middle, high)
                self.left[node], self.right[node] = left, right
            return node

        build(0, len(ids))
        self.vectors, self.ids = vectors[order], ids[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows (query place, id, score) among which each query's best k are; ``bound`` holds k-th scores known so far.

        Scores equal to the k-th are kept, since a smaller id may win. Queries
        that come to a node together are scored in one matrix product.
        """
        n = len(queries)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        dtype = np.float64
        top = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        if top >= EXACT:
            dtype = np.int64 if top < EXACT_64 else object
        q, v = queries.astype(dtype), self.vectors.astype(dtype)
        bounds = queries.astype(np.float64) @ self.centres.T + length[:, None] * self.radii
        bounds += 1e-9 * (np.abs(bounds) + length[:, None] * (self.radii + 1))  # rounding must not cut a true neighbour
        kth = bound.astype(np.float64)
        if dtype is not np.float64:  # beyond 2**53 a bound is rounded; it must not be too high
            kth = np.nextafter(kth, -np.inf)
        floor = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min}.get(dtype, -(1 << 200))
        scores = np.full((n, k), floor, dtype=dtype)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack: list[tuple[int, np.ndarray]] = [(0, np.arange(n))]
        while stack:
            node, who = stack.pop()
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            if self.left[node] >= 0:
                left, right = self.left[node], self.right[node]
                first = bounds[who, left] >= bounds[who, right]
                # The stack's top is visited first: the side with the larger bound.
                a, b = who[first], who[~first]
                stack += [(right, a), (left, b), (left, a), (right, b)]
                continue
            low, high = self.low[node], self.high[node]
            product = q[who] @ v[low:high].T
            ids = self.ids[low:high]
            same = query_ids[who][:, None] == ids[None, :]
            good = (product >= kth[who][:, None]) & ~same
            at, column = np.nonzero(good)
            if not len(at):
                continue
            found.append((who[at], ids[column], product[at, column].astype(object if dtype is object else np.int64)))
            candidates = np.concatenate([scores[who], np.where(good, product, floor)], axis=1)
            ordered = np.sort(candidates, axis=1) if dtype is object else np.partition(candidates, candidates.shape[1] - k, axis=1)
            scores[who] = ordered[:, -k:]
            full = scores[who].min(axis=1)
            known = full > floor
            reached = full[known].astype(np.float64)
            kth[who[known]] = np.maximum(kth[who[known]], reached if dtype is np.float64 else np.nextafter(reached, -np.inf))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, ids, score = (np.concatenate(x) for x in zip(*found))
        keep = score >= kth[place]
        place, ids, score = place[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, place)) if dtype is not object else np.array(
            sorted(range(len(place)), key=lambda i: (place[i], -score[i], ids[i])), dtype=np.int64
        )
        place, ids, score = place[order], ids[order], score[order]
        start = np.searchsorted(place, place, side="left")
        keep = np.arange(len(place)) - start < k
        score = score[keep]
        if dtype is object and any(abs(s) >= 1 << 63 for s in score):
            raise OverflowError("a best inner product is no 64-bit number")
        return place[keep], ids[keep], score.astype(np.int64)


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as whole numbers; null if the vector cannot take part."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )

    def whole(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * float(scale))
        large = F.raise_error(F.lit("a vector has a component that is no 64-bit number after scaling")).cast("long")
        return F.when(F.abs(x.cast("double") * float(scale)) < 2.0**63, scaled.cast("long")).otherwise(large)

    return F.when(usable, F.transform(vector, whole))


def _searched(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    tree = BallTree(np.array(left["c_v"].tolist(), dtype=np.int64), left["vec_id"].to_numpy(np.int64))
    queries = np.array(right["q_v"].tolist(), dtype=np.int64)
    query_ids = right["query_id"].to_numpy(np.int64)
    place, ids, score = tree.search(queries, query_ids, k, right["bound"].to_numpy(np.float64))
    return pd.DataFrame({"query_id": query_ids[place], "vec_id": ids, "score": score})


def _search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "shard", "query_block"]
    # Both sides come from one table; aliases keep their columns apart.
    left = candidates.select(*[F.col(c).alias(f"c_{c}") for c in keys], "vec_id", F.col("v").alias("c_v"))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], "query_id", F.col("v").alias("q_v"), "bound")
    return (
        left.groupBy(*[f"c_{c}" for c in keys])
        .cogroup(right.groupBy(*[f"q_{c}" for c in keys]))
        .applyInPandas(lambda a, b: _searched(a, b, k), "query_id long, vec_id long, score long")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_inner_products(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                       shard_rows: int = 8_192, query_rows: int = 4_096) -> DataFrame:
    """``query_id, rank, vec_id, score``: every query's ``k`` largest whole-number inner products with other rows.

    Ties go to the smaller id. Rows whose id or vector is null, or whose vector
    is empty or holds a null or non-finite component, take no part; vectors of
    different lengths are not compared. Rows with a repeated id are candidates
    each, but not of a query with that id. An empty table gives no rows.

    Candidates fall into shards of about ``shard_rows``, queries into blocks of
    about ``query_rows``; a task holds one of each. All queries meet all
    candidates in this way, which is the stated query set against all rows.
    Inner products are exact: beyond 2**53 in 64-bit, beyond 2**62 in Python's
    integers. A component, or one of a query's best products, that has no place
    in 64 bits is an error.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr("true").alias("t"), is_query.alias("q"),
                     whole_numbers(F.col(vector)).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v")).drop("t")
    rows = written(rows)
    count = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    shards = max(1, -(-count["n"] // shard_rows))
    blocks = max(1, -(-count["q"] // query_rows))
    number = F.xxhash64("vec_id", "v")
    candidates = rows.select("vec_id", "v", "dim", F.pmod(number, F.lit(shards)).cast("int").alias("shard"))
    candidates = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.filter("q").select(
        F.col("vec_id").alias("query_id"),
        "v",
        "dim",
        F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int").alias("query_block"),
        F.pmod(F.xxhash64(F.lit("home"), "vec_id"), F.lit(shards)).cast("int").alias("home"),
    ).dropDuplicates(["query_id", "v"])
    no_bound = F.lit(float("-inf"))
    first = _search(candidates, queries.withColumns({"shard": F.col("home"), "bound": no_bound}).drop("home"), k)
    first = written(first)
    if shards > 1:
        kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
        bounded = (
            queries.join(kth.select("query_id", "kth"), "query_id", "left")
            .withColumn("bound", F.coalesce(F.col("kth").cast("double"), no_bound))
            .withColumn("shard", F.explode(others))
            .drop("kth", "home")
        )
        first = first.unionByName(_search(candidates, bounded, k))
    return _best(first, k).select("query_id", "rank", "vec_id", "score")
