"""Quantiles by counted values and running sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevitals.operators.batch import Batch
from tablevitals.operators.outliers import outlier
from tablevitals.operators.quantiles import partition_ends, quantiles, value_counts_by_group

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def check(spark, rows, probs=PROBS):
    df = spark.createDataFrame(rows, "g string, c int, v double").groupBy("g", "c", "v").agg(F.count("*").alias("n"))
    found = {(r["g"], r["c"]): (r["n"], r["q"]) for r in quantiles(df, probs).collect()}
    values = {}
    for g, c, v in rows:
        values.setdefault((g, c), []).append(v)
    assert found.keys() == values.keys()
    for key, (n, q) in found.items():
        assert n == len(values[key]) and q == pytest.approx(np.quantile(values[key], probs).tolist(), rel=1e-12), key
    return found


def test_columns_of_many_kinds(spark):
    rng = np.random.default_rng(2)
    columns = {
        0: rng.normal(size=2001),
        1: np.concatenate([rng.normal(size=500), [1e300, -1e300, 1e308, -1e308]]),
        2: np.repeat([7.0, 8.0], [900, 100]),  # one value fills most of it
        3: np.exp(rng.normal(scale=40, size=1000)),  # spread over many magnitudes
        4: np.array([3.5]),
    }
    check(spark, [("k" if c % 2 else "", c, float(v)) for c, values in columns.items() for v in values])


def test_one_large_among_many_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("large", 0, float(v)) for v in rng.normal(size=5000)]
    rows += [(f"g{i}", c, float(v)) for i in range(400) for c in (0, 1) for v in rng.integers(0, 9, rng.integers(1, 6))]
    rows += [("zero", 0, 0.0)] * 3000 + [("zebra", 0, float(i)) for i in range(700)]
    check(spark, rows)


def test_groups_over_every_border(spark):
    """Ranges of 13 rows: groups begin, end, and go on over whole partitions at all places."""
    rng = np.random.default_rng(6)
    rows = [(g, 0, float(v)) for g, n in zip("abcdefgh", (1, 40, 13, 2, 60, 5, 1, 26)) for v in rng.permutation(n)]
    counts = spark.createDataFrame(rows, "g string, c int, v double").withColumn("n", F.lit(2).cast("long"))
    session = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        kept = []
        found = {r["g"]: r for r in quantiles(counts, PROBS, lambda df: kept.append(df.persist()) or kept[-1]).collect()}
        ends = partition_ends(kept[0])
        assert len(ends) > 8 and any(e.before and e.after for e in ends.values())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", session)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for g in "abcdefgh":
        values = [v for k, _, v in rows if k == g] * 2
        assert found[g]["n"] == len(values) and found[g]["q"] == pytest.approx(np.quantile(values, PROBS).tolist())


def test_infinite_and_missing_values(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf"), None]
    df = spark.createDataFrame([(v, None, "a") for v in values] + [(9.0, 1.0, None)], "v double, w double, g string")
    counts = value_counts_by_group(df, {"v": F.col("v"), "w": F.col("w")}, F.col("g"))
    assert [(r["g"], r["c"], r["n"], r["q"]) for r in quantiles(counts, [0.25, 0.5, 0.75]).collect()] == [("a", 0, 5, [1.0, 2.0, 3.0])]
    whole = value_counts_by_group(df, {"w": F.col("w")})
    assert [(r["n"], r["q"]) for r in quantiles(whole, [0.5]).collect()] == [(1, [1.0])]
    assert quantiles(whole.limit(0), [0.5]).count() == 0


def test_outliers_of_groups_and_columns(spark):
    """Robust z-scores of several columns by group against numpy, and of a group without values."""
    rng = np.random.default_rng(7)
    rows = [(i, f"g{i % 7}", float(a), None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(rng.standard_cauchy((3000, 2)))]
    rows += [(5000 + i, "empty", None, None) for i in range(9)] + [(6000, "few", 1.0, 2.0), (6001, "few", 1e9, 2.0)]
    df = spark.createDataFrame(rows, "_row_index long, g string, a double, b double")
    got = {(int(r["row_reference"]), r["column"]) for r in outlier(Batch(df), ["a", "b"], "g").collect()}
    want = set()
    for name, at in (("a", 2), ("b", 3)):
        for g in {r[1] for r in rows}:
            mine = [(r[0], r[at]) for r in rows if r[1] == g and r[at] is not None]
            if len(mine) >= 3:
                v = np.array([x for _, x in mine])
                spread = np.median(np.abs(v - np.median(v)))
                want |= {(i, name) for i, x in mine if spread and abs(0.6745 * (x - np.median(v)) / spread) > 3.5}
    assert got == want and len(want) > 500
