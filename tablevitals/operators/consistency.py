"""Rare spellings that closely match a frequent value of the same column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.functions.columns import as_text, is_text, long_form
from tablevitals.functions.fuzzy import best_match_udf
from tablevitals.functions.pyformat import fixed_text
from tablevitals.operators.batch import Batch, literal_map
from tablevitals.operators.issues import issue_row, no_issues
from tablevitals.operators.profile import value_counts

# Frequent values scored at once, rare values per row and such rows per block of frequent values.
FREQUENT_PER_BLOCK = 512
RARE_PER_LIST = 512
LISTS_PER_PART = 32
MOST_TASKS = 10_000  # beyond it tasks grow; the driver holds figures of every task

# Lengths at which a value one letter apart outscores all others: from 11 on it has over 95, and without it only
# two letters or more could be apart, or words rearranged, which gives 95 at most. Longer values only cost more keys.
ONE_LETTER_APART = (11, 64)


def most_frequent(frequent: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per column, ties in value order.

    ``row_number`` under a limit keeps the top rows of every task before the
    shuffle, so a column's values never meet in one place.
    """
    order = Window.partitionBy("column").orderBy(F.desc("value_count"), "value")
    place = F.row_number().over(order)
    return frequent.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def one_letter_apart(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rare`` rows with a frequent value that has one letter more or less: the best such value and its score.

    Values meet by the hash of what is left without one of their letters, so the work is linear in their letters.
    """
    shortest, longest = ONE_LETTER_APART
    size = F.char_length("value")
    whole = F.xxhash64("value")
    without = F.transform(
        F.sequence(F.lit(1), size), lambda i: F.xxhash64(F.concat(F.substr("value", F.lit(1), i - 1), F.substr("value", i + 1)))
    )
    left = rare.select("column", "value", "first_row").filter(size.between(shortest, longest))
    right = frequent.select("column", "value", "value_count").filter(size.between(shortest - 1, longest + 1))
    other = lambda key: right.withColumn("key", key).withColumnsRenamed({"value": "match", "value_count": "n"})
    # One key a letter: the size that the optimizer guesses is too small for a broadcast.
    longer = left.withColumn("key", whole).join(other(F.explode(F.array_distinct(without))).hint("merge"), ["column", "key"])
    shorter = left.withColumn("key", F.explode(F.array_distinct(without))).join(other(whole).hint("merge"), ["column", "key"])
    lengths = [F.char_length("value"), F.char_length("match")]
    score = (F.lit(200.0) * F.least(*lengths) / (lengths[0] + lengths[1])).cast("float")
    pairs = longer.unionByName(shorter).filter((lengths[0] != lengths[1]) & (F.levenshtein("value", "match", 1) == 1))
    best = F.min(F.struct((-score).alias("score"), (-F.col("n")).alias("order"), "match"))
    return (
        pairs.groupBy("column", "value", "first_row")
        .agg(best.alias("best"))
        .select("column", "value", "first_row", "best.match", (-F.col("best.score")).alias("score"))
    )


def best_matches(
    rare: DataFrame, frequent: DataFrame, threshold: float, sizes: dict[str, tuple[int, int]], kept: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``rare`` rows with their best frequent value at or above the threshold: score, then count, then value decide.

    ``sizes`` holds the number of frequent and rare values per column, ``kept``
    keeps a table that is read several times. Where a frequent value is one
    letter apart and no other can score as high, it is found by keys; all other
    rare values are compared with every frequent one.
    """
    near = kept(one_letter_apart(rare, frequent))
    settled = {r["column"]: r["count"] for r in near.groupBy("column").count().collect()}
    left = {c: (n, m - settled.get(c, 0)) for c, (n, m) in sizes.items() if m > settled.get(c, 0)}
    found = near.filter(F.col("score") >= threshold)
    if not left:
        return found
    rest = rare.join(near.select("column", "value"), ["column", "value"], "left_anti") if settled else rare
    of_columns = frequent.filter(F.col("column").isin(list(left)))
    return found.unionByName(compared_with_all(rest.filter(F.col("column").isin(list(left))), of_columns, threshold, left))


def compared_with_all(rare: DataFrame, frequent: DataFrame, threshold: float, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Best matches by comparing every rare with every frequent value of its column.

    Both sides are dealt by hash into lists of bounded length, and every list of rare
    values meets every list of frequent ones of its column. Lists are sent once
    per block of the other side, so that no column meets in one task, and
    candidates that cannot win are ruled out inside a list by an upper bound.
    """
    count = lambda column, n, per: literal_map({c: -(-v[n] // per) for c, v in sizes.items()}, column).cast("bigint")
    column, spread, zero = F.col("column"), F.xxhash64("value"), F.lit(0).cast("bigint")
    blocks, lists = count(column, 0, FREQUENT_PER_BLOCK), count(column, 1, RARE_PER_LIST)
    parts = count(column, 1, RARE_PER_LIST * LISTS_PER_PART)
    candidates = (
        frequent.groupBy("column", F.pmod(spread, blocks).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("value_count")).alias("order"), "value"))).alias("candidates"))
        .withColumn("part", F.explode(F.sequence(zero, parts - 1)))
    )
    rare_lists = (
        rare.groupBy("column", F.pmod(spread, lists).alias("list"))
        .agg(F.collect_list(F.struct("value", "first_row")).alias("rare"))
        .withColumn("block", F.explode(F.sequence(zero, blocks - 1)))
        .withColumn("part", F.pmod("list", parts))
    )
    match = best_match_udf(threshold)
    scored = (
        # Copies of lists: the optimizer guesses their size before they are copied, and would broadcast them.
        rare_lists.join(candidates.hint("merge"), ["column", "block", "part"])
        # Scoring is CPU work on few bytes, so it gets its own even spread.
        .repartition(_tasks(rare.sparkSession, sizes), "column", "block", "list")
        .withColumn("m", match(F.col("rare.value"), F.col("candidates.value")))
        .select("column", "candidates", F.inline(F.arrays_zip("rare", "m")))
        .filter(F.col("m.score") >= threshold)
        .withColumn("found", F.col("candidates")[F.col("m.match_no")])
    )
    best = F.min(F.struct((-F.col("m.score")).alias("score"), "found.order", "found.value"))
    return (
        scored.groupBy("column", "rare.value", "rare.first_row")
        .agg(best.alias("best"))
        .select("column", "value", "first_row", F.col("best.value").alias("match"), (-F.col("best.score")).alias("score"))
    )


def _tasks(spark: SparkSession, sizes: dict[str, tuple[int, int]]) -> int:
    """One task per ``LISTS_PER_PART`` pairs of lists, at least one per core."""
    pairs = sum(-(-a // FREQUENT_PER_BLOCK) * -(-b // RARE_PER_LIST) for a, b in sizes.values())
    return min(max(spark.sparkContext.defaultParallelism, pairs // LISTS_PER_PART), MOST_TASKS)


def consistency(batch: Batch, columns: list[str] | None = None) -> DataFrame:
    """Judges text columns by their value counts.

    Which columns are judged follows from the value-count pass; their counts,
    with the row of every value that occurs once, are then all that is needed.
    Rows are joined again only for ``min_value_count > 2``. Every frequent value
    is a candidate unless the caller sets ``max_common_candidates``, which leaves
    out all but that many of the most frequent ones.
    """
    df, spark = batch.df, batch.df.sparkSession
    if not batch.enabled("consistency"):
        return no_issues(spark)
    params = batch.params("consistency")
    threshold = params.get("fuzzy_match_threshold", 85)
    min_count = params.get("min_value_count", 2)
    limit = params.get("max_common_candidates")
    texts = [c for c in (columns if columns is not None else batch.texts) if c in batch.columns]
    texts = [c for c in texts if is_text(df.schema[c].dataType)]
    judged = []
    for name in texts:
        distinct, rare_values = batch.value_stats.get(name, (0, 0))
        if judged_by_ratio(batch.rows, distinct, rare_values, params):
            judged.append(name)
    if not judged:
        return no_issues(spark)
    counts = batch.kept(value_counts(df, judged, batch.row_key))
    frequent = counts.filter(F.col("value_count") >= min_count)
    rare = counts.filter(F.col("value_count") < min_count)
    sizes = {c: (batch.value_stats[c][0] - batch.value_stats[c][1], batch.value_stats[c][1]) for c in judged}
    if limit is not None:
        frequent = most_frequent(frequent, limit)
        sizes = {c: (min(n, limit), m) for c, (n, m) in sizes.items()}
    matched = best_matches(rare, frequent, threshold, sizes, batch.kept)
    if min_count <= 2:
        rows = matched.withColumn("key", F.col("first_row"))  # a rare value has one row
    else:
        cells = [F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in judged]
        rows = long_form(df, cells, [batch.key.alias("key")]).join(matched, ["column", "value"])
    ordinal = F.array_position(F.array(*[F.lit(c) for c in batch.columns]), F.col("column")) - 1
    return naming_issues(rows.withColumn("ord", ordinal))


def judged_by_ratio(rows: int, distinct: int, rare: int, params: dict) -> bool:
    """Whether a column has rare and frequent values and isn't free text."""
    sample = params.get("min_sample_size_for_ratio_filter", 10)
    free_text = rows >= sample and distinct / rows > params.get("max_unique_ratio", 0.5)
    return not free_text and 0 < rare < distinct


def naming_issues(rows: DataFrame, *keep: str) -> DataFrame:
    """Issues of values ``key, column, ord, value, match, score``, behind the columns to keep."""
    score_text = fixed_text(F.col("score").cast("double"), 0)
    return rows.select(
        *keep,
        *issue_row(
            "consistency",
            row_reference=F.col("key"),
            column=F.col("column"),
            description=F.concat(
                F.lit("'"), "value", F.lit("' in column '"), "column",
                F.lit("' closely matches the far more common value '"), "match", F.lit("' ("), score_text,
                F.lit("% similarity) — likely a naming inconsistency that will break joins/counts"),
            ),
            severity=F.lit("medium"),
            row_index=F.col("key").cast("string"),
            metric=F.col("score").cast("double"),
            column_ord=F.col("ord"),
        ),
    )
