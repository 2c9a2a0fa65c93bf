"""Quality rules by robust multivariate outliers.

Each document gives a vector of transformed text statistics. For every language
and source the minimum covariance determinant estimates centre and scatter of
the bulk; documents whose Mahalanobis distance is beyond a high quantile are
rejected. All documents take part in every step; only sums per group are held
together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import WORD_SPACE, carries_its_code, fresh, map_column, written

carries_its_code(__name__)

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
WINDOW = 5
# Shares are pulled towards a usual value with the weight of so many words, so that short texts don't stand out by chance.
PRIOR_WORDS = 20.0
PRIOR_WORD_CHARS = 5.0
# Scatter below these standard deviations is not told from none (log length, then square roots of shares).
SMALLEST_SPREAD = (0.04, 0.04, 0.05, 0.08, 0.04)
WIDTH = len(SMALLEST_SPREAD)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class McdParameters:
    share: float = 0.75  # of a group that the estimate rests on
    steps: int = 4
    smallest_group: int = 100  # smaller groups are pooled by language, then together
    cut: float = 36.0  # squared distance; five normal statistics stay below it but for one text in a million


def repeated_words(words: list) -> int:
    """Words inside five-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def statistics(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """Words, characters in words, symbols, repeated lines, repeated words, and the transformed vector."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and x.strip(WORD_SPACE)] if "\n" in text else []
    repeated = repeated_words(words) if n > WINDOW else 0
    raw = np.frombuffer(data, dtype=np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    marks = sum(map(text.count, MARKS))
    weight = n + PRIOR_WORDS
    vector = [
        float(np.log((chars + PRIOR_WORDS * PRIOR_WORD_CHARS) / weight)),
        (symbols / (chars + PRIOR_WORDS * PRIOR_WORD_CHARS)) ** 0.5,
        (capitals / (chars + PRIOR_WORDS * PRIOR_WORD_CHARS)) ** 0.5,
        (repeated / weight) ** 0.5,
        (marks / weight) ** 0.5,
    ]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, vector


def with_statistics(df: DataFrame, text: str, vector: str) -> DataFrame:
    """``df`` with the base statistics and the vector in place of the text."""

    def start() -> Callable[[list], list]:
        return lambda texts: [list(c) for c in zip(*[statistics(t or "") for t in texts])] if texts else [[]] * 6

    return map_column(df, text, f"{BASE}, {vector} array<double>", start).drop(text)


def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre and inverse scatter from a group's count, sums and sums of products."""
    for batch in batches:
        rows = batch.to_pydict()
        centres, inverses, sizes = [], [], []
        for n, sums, products in zip(rows["n"], rows["sums"], rows["products"]):
            centre = np.array(sums) / n
            scatter = np.zeros((WIDTH, WIDTH))
            scatter[np.triu_indices(WIDTH)] = np.array(products) / n
            scatter = scatter + np.triu(scatter, 1).T - np.outer(centre, centre)
            scatter += np.diag(np.square(SMALLEST_SPREAD))
            inverse = np.linalg.inv(scatter)
            centres.append(centre.tolist())
            inverses.append(((inverse + inverse.T) / 2).ravel().tolist())
            sizes.append(float(np.linalg.slogdet(scatter)[1]))
        yield pa.RecordBatch.from_pydict(
            {
                "group": batch.column("group"),
                "start": batch.column("start"),
                "centre": pa.array(centres, pa.list_(pa.float64())),
                "inverse": pa.array(inverses, pa.list_(pa.float64())),
                "log_size": pa.array(sizes, pa.float64()),
            }
        )


ESTIMATE = "group string, start int, centre array<double>, inverse array<double>, log_size double"


def squared_distance(x: Column, centre: Column, inverse: Column) -> Column:
    off = [x[i] - centre[i] for i in range(WIDTH)]
    terms = [off[i] * off[j] * inverse[i * WIDTH + j] * (1 if i == j else 2) for i in range(WIDTH) for j in range(i, WIDTH)]
    return sum(terms[1:], terms[0])


def moments(rows: DataFrame, weight: Column, vector: str = "x") -> DataFrame:
    x = F.col(vector)
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
    summed = rows.groupBy("group", "start").agg(
        F.sum(weight).alias("n"),
        *[F.sum(weight * x[i]).alias(f"s{i}") for i in range(WIDTH)],
        *[F.sum(weight * x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs],
    )
    return summed.filter("n > 0").select(
        "group",
        "start",
        "n",
        F.array(*[f"s{i}" for i in range(WIDTH)]).alias("sums"),
        F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("products"),
    )


def estimate(rows: DataFrame, p: McdParameters) -> DataFrame:
    """Centre and inverse scatter of every ``group`` of ``rows (group, x)``: the better of two starts after C-steps.

    The starts are the rows near the medians in units of median absolute
    deviation, and all rows with far values damped. A C-step keeps the given
    share of rows with the smallest distances and estimates anew. The quantile
    of the distances is a mergeable sketch; no group is sorted or gathered.
    """
    x = F.col("x")
    # Figures of a group are written before rows meet them: their known size then decides how, and no group is dealt to one task.
    medians = F.array(*[F.percentile_approx(x[i], 0.5, 10_000) for i in range(WIDTH)])
    middle = written(rows.groupBy("group").agg(medians.alias("middle")))
    apart = rows.join(middle, "group").withColumn("apart", F.array(*[F.abs(x[i] - F.col("middle")[i]) for i in range(WIDTH)]))
    spread = apart.groupBy("group").agg(
        F.first("middle").alias("middle"),
        F.array(
            *[
                F.greatest(1.4826 * F.percentile_approx(F.col("apart")[i], 0.5, 10_000), F.lit(SMALLEST_SPREAD[i]))
                for i in range(WIDTH)
            ]
        ).alias("spread"),
    )
    spread = written(spread)
    scaled = rows.join(spread, "group")
    z = [(x[i] - F.col("middle")[i]) / F.col("spread")[i] for i in range(WIDTH)]
    far = F.sqrt(sum([v * v for v in z[1:]], z[0] * z[0]))
    near = (far <= (2.0 * WIDTH) ** 0.5).cast("double")
    damped = F.lit(1.0) / (1.0 + far * far / WIDTH)
    two = scaled.select("group", "x", F.explode(F.array(F.struct(F.lit(0).alias("start"), near.alias("w")),
                                                       F.struct(F.lit(1).alias("start"), damped.alias("w")))).alias("s"))
    two = two.select("group", "x", "s.start", "s.w")
    now = written(moments(two, F.col("w")).mapInArrow(solved, ESTIMATE))
    for _ in range(p.steps):
        far_rows = rows.join(now, "group").withColumn("d2", squared_distance(x, F.col("centre"), F.col("inverse")))
        bound = written(far_rows.groupBy("group", "start").agg(F.percentile_approx("d2", p.share, 10_000).alias("bound")))
        kept = far_rows.join(bound, ["group", "start"]).withColumn("w", (F.col("d2") <= F.col("bound")).cast("double"))
        now = written(moments(kept, F.col("w")).mapInArrow(solved, ESTIMATE))
    best = now.groupBy("group").agg(F.min_by(F.struct("centre", "inverse"), F.struct("log_size", "start")).alias("b"))
    best = best.select("group", "b.centre", "b.inverse")
    # The scatter of the inner share is too small; the median distance tells by how much.
    d2 = squared_distance(x, F.col("centre"), F.col("inverse"))
    scale = rows.join(best, "group").groupBy("group").agg((F.percentile_approx(d2, 0.5, 10_000) / 4.3515).alias("scale"))
    return written(best.join(scale, "group").withColumn("scale", F.greatest("scale", F.lit(1.0))))


def quality_rules(df: DataFrame, parameters: McdParameters = McdParameters(), text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """``df`` without its text, with base statistics, ``base_failed``, ``distance`` (squared) and ``kept``.

    A row is kept if it passes the base rules and its distance in its group is
    at most ``cut``. Groups below ``smallest_group`` rows are pooled by language,
    then all together; if that pool is small as well, its rows have no distance
    and only the base rules count. Only rows that pass the base rules shape the
    estimates. A null text has no words and fails; null languages and sources are
    groups of their own. Repeated rows stay; an empty table gives no rows;
    columns with the new names are replaced.
    """
    p = parameters
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    df = df.drop(*[c for c in new if c not in (text, lang, source)])
    vector, key = fresh(df, "statistics_vector", "group_key")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = with_statistics(df, text, vector).withColumn("base_failed", failed)
    language = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("-"))
    origin = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    rows = written(rows.withColumn(key, F.to_json(F.array(language, origin))))
    ok = rows.filter(~F.col("base_failed"))
    by_source = ok.groupBy(F.col(key).alias("key"), language.alias("pool")).count()
    pooled = by_source.withColumn("small", F.col("count") < p.smallest_group)
    by_language = pooled.filter("small").groupBy("pool").agg((F.sum("count") < p.smallest_group).alias("pool_small"))
    group = F.when(~F.col("small"), F.col("key")).when(F.col("pool_small"), F.lit("all")).otherwise(F.col("pool"))
    groups = pooled.join(by_language, "pool", "left").select("key", group.alias("group"), "count")
    sizes = groups.groupBy("group").agg((F.sum("count") >= p.smallest_group).alias("judged"))
    groups = written(groups.join(sizes, "group").filter("judged").select("key", "group"))
    # Of the table's own columns none takes part, so that none can share a name with these.
    member = ok.select(F.col(key).alias("key"), F.col(vector).alias("x")).join(groups, "key").select("group", "x")
    found = written(groups.join(estimate(member, p), "group").withColumnsRenamed({"centre": "mcd_centre"}))
    centre, inverse, scale, name = fresh(rows, "mcd_c", "mcd_i", "mcd_s", "mcd_key")
    found = found.select(
        F.col("key").alias(name),
        F.col("mcd_centre").alias(centre),
        F.col("inverse").alias(inverse),
        F.col("scale").alias(scale),
    )
    d2 = squared_distance(F.col(vector), F.col(centre), F.col(inverse)) / F.col(scale)
    return (
        rows.join(found, rows[key] == found[name], "left")
        .withColumn("distance", d2)
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > p.cut, F.lit(False)))
        .drop(vector, key, name, centre, inverse, scale)
    )
