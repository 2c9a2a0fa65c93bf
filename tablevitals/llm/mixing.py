"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Only DataFrame expressions. Source shares are raised to an exponent found by
bisection, so that the weights reach a target entropy or the scarcest source is
not repeated beyond a limit. Every source then gets its part of the token
budget: whole passes over its documents, each in an order of its own, and a
part of one more pass. The result is cut into blocks in which each source has
its weight, and every block is permuted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablevitals.llm.common import fresh, written

BISECTIONS = 60


def token_count(text: Column | str) -> Column:
    """Words of the text, at least 1; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def weights_for(shares: Column, exponent: Column) -> Column:
    """Normalised powers of an array of shares."""
    powers = F.transform(shares, lambda p: F.pow(p, exponent))
    return F.aggregate(powers, F.lit(0.0), lambda a, b: a + b, lambda total: F.transform(powers, lambda w: w / total))


def entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a - w * F.log(w))


def repeats(shares: Column, exponent: Column, budget: Column) -> Column:
    """Largest number of passes over a source; ``budget`` is in passes over the corpus, null for one pass of the last."""
    passes = F.transform(F.arrays_zip(shares.alias("p"), weights_for(shares, exponent).alias("w")), lambda s: s["w"] / s["p"])
    return F.when(budget.isNull(), F.array_max(passes) / F.array_min(passes)).otherwise(F.array_max(passes) * budget)


def bisect(low: Column, high: Column, too_low) -> Column:
    """The place where ``too_low`` turns, by a fixed number of halvings; the upper end of the last interval."""
    start = F.struct(low.alias("low"), high.alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        below = too_low(middle)
        return F.struct(
            F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step)["high"]


def source_weights(totals: DataFrame, source: str, target_entropy: float | None, max_repeats: float | None,
                   budget_tokens: int | None) -> DataFrame:
    """``source, tokens, exponent, weight, source_budget`` for every row of ``totals (source, tokens)``.

    The exponent lies between 0 (equal weights) and 1 (the corpus' own). It is
    the largest with at least ``target_entropy`` times the entropy of equal
    weights, then raised as far as ``max_repeats`` asks. Without a budget, the
    budget is the least that lets no source fall below one pass.
    """
    all_sources = totals.agg(
        F.sort_array(F.collect_list(F.struct(F.col("tokens"), F.col(source).alias("s")))).alias("rows"),
        F.sum("tokens").cast("double").alias("all_tokens"),
    ).filter("all_tokens > 0")
    shares = F.transform("rows", lambda r: r["tokens"] / F.col("all_tokens"))
    table = all_sources.withColumn("shares", shares)
    budget = F.lit(None).cast("double") if budget_tokens is None else F.lit(float(budget_tokens)) / F.col("all_tokens")
    exponent = F.lit(1.0)
    if target_entropy is not None:
        wanted = F.lit(float(target_entropy)) * F.log(F.size("shares").cast("double"))
        reached = bisect(F.lit(0.0), F.lit(1.0), lambda a: entropy(weights_for(F.col("shares"), a)) >= wanted)
        # Equal weights have the most entropy; the lower end keeps the target where rounding is at its edge.
        exponent = F.when(entropy(F.col("shares")) >= wanted, F.lit(1.0)).otherwise(reached)
    elif max_repeats is not None:
        exponent = F.lit(0.0)
    # One row; written so that later expressions use the number found and don't search again inside their own steps.
    table = written(table.withColumn("exponent", exponent))
    if max_repeats is not None:
        limit = F.lit(float(max_repeats))
        raised = bisect(F.col("exponent"), F.lit(1.0), lambda a: repeats(F.col("shares"), a, budget) > limit)
        within = repeats(F.col("shares"), F.col("exponent"), budget) <= limit
        table = written(table.withColumn("exponent", F.when(within, F.col("exponent")).otherwise(raised)))
    weights = weights_for(F.col("shares"), F.col("exponent"))
    spread = F.arrays_zip(F.col("rows").alias("r"), weights.alias("w"), F.col("shares").alias("p"))
    table = written(table.withColumn("spread", spread))
    fewest = F.array_min(F.transform("spread", lambda s: s["w"] / s["p"]))
    passes = (1.0 / fewest) if budget_tokens is None else budget
    return table.select("exponent", (passes * F.col("all_tokens")).alias("budget"), F.explode("spread").alias("s")).select(
        F.col("s.r.s").alias(source),
        F.col("s.r.tokens").alias("tokens"),
        "exponent",
        F.col("s.w").alias("weight"),
        F.greatest(F.round(F.col("s.w") * F.col("budget")).cast("long"), F.lit(1)).alias("source_budget"),
    )


def temperature_mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
                    target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None,
                    blocks: int = 64, seed: int = 5) -> DataFrame:
    """Rows of ``df`` drawn to the weights, with ``pass_no``, ``mix_block`` (both from 0) and ``mix_order``.

    Whole passes hold every row of the source once. The last, partial pass takes
    rows in its random order until the budget is reached, the row that reaches
    it included. ``mix_block`` is the part of the source's budget at which a row
    starts, ``mix_order`` a random text; the blocks, each in this order, are the
    mixture. Running sums are taken over the parts of each pass (the first two
    digits of the random order), then inside each part.

    A row's tokens are its words, at least 1, so null and empty texts count 1.
    Null sources are a source of their own. Repeated rows stay apart by their
    number. An empty table gives no rows. Columns with the new names are replaced.
    """
    df = df.drop(*[c for c in ("pass_no", "mix_block", "mix_order") if c not in (source, text, key)])
    names = ("row_at", "row_tokens", "row_source", "plan_source", "plan_budget", "plan_tokens", "order_part",
             "part_start", "token_start")
    number, size, origin, s, budget, pass_tokens, part, part_start, start = fresh(df, *names)
    rows = df.withColumns({number: F.monotonically_increasing_id(), size: token_count(text)})
    rows = rows.withColumn(origin, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")))
    totals = rows.groupBy(origin).agg(F.sum(size).alias("tokens"))
    weights = written(source_weights(totals, origin, target_entropy, max_repeats, budget_tokens))
    plan = weights.select(
        F.col(origin).alias(s), F.col("source_budget").alias(budget), F.col("tokens").alias(pass_tokens)
    )
    drawn = rows.join(plan, rows[origin] == plan[s])
    passes = F.sequence(F.lit(0), F.ceil(F.col(budget) / F.col(pass_tokens)).cast("int") - 1)
    drawn = drawn.withColumn("pass_no", F.explode(passes))
    named = F.concat_ws(":", F.lit(seed), F.col("pass_no"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = drawn.withColumn("mix_order", F.md5(named)).withColumn(part, F.substring("mix_order", 1, 2))
    before = Window.partitionBy(s, "pass_no").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.groupBy(s, "pass_no", part).agg(F.sum(size).alias(size))
    parts = parts.withColumn(part_start, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size)
    inside = Window.partitionBy(s, "pass_no", part).orderBy("mix_order", number)
    earlier = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        drawn.withColumn(start, F.col("pass_no") * F.col(pass_tokens) + earlier)
        .join(parts, [s, "pass_no", part])
        .withColumn(start, F.col(start) + F.col(part_start))
        .filter(F.col(start) < F.col(budget))
        .withColumn("mix_block", F.expr(f"int(`{start}` * {blocks} div `{budget}`)"))
        # Another random order, apart from the one that cut the passes.
        .withColumn("mix_order", F.md5(F.concat("mix_order", F.lit(":block"))))
        .select(*df.columns, "pass_no", "mix_block", "mix_order")
    )
