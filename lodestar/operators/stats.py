"""Paired tests, intervals and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96
#: Discordant pairs below which no exact paired test reaches 0.05.
LEAST_DISCORDANT = 6
#: Verdicts.
UNDECIDABLE, SIGNIFICANT, NOT_SIGNIFICANT = "판정불가", "유의", "유의하지 않음"


def contingency(outcomes: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Counts over the queries of two strategies in outcomes (qid, strategy, correct); a query of only one raises when read."""
    x = outcomes.where(F.col("strategy") == a).select(*by, "qid", F.col("correct").alias("x"))
    y = outcomes.where(F.col("strategy") == b).select(*by, "qid", F.col("correct").alias("y"))
    both = x.join(y, [*by, "qid"], "full_outer")
    both = both.withColumn("x", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x")).otherwise(F.raise_error(F.lit("strategies differ in their queries")).cast("boolean")))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("a_only"),
        F.count_if(~F.col("x") & F.col("y")).alias("b_only"), F.count_if(~F.col("x") & ~F.col("y")).alias("neither"),
    ).withColumn("discordant", F.col("a_only") + F.col("b_only"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, good to 1e-13 for n of 100 and more."""
    x = n.cast("double") + 1
    return (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x)


def binom_half(k: Column, n: Column) -> Column:
    """Exact two-sided p of k of n at one half; 1 for n = 0.

    Terms are summed by their ratios, from the first for n below 1,000 and from
    the largest beyond, where the first would underflow.
    """
    m = F.least(k, n - k).cast("int")
    step = lambda a, i: F.struct((a.c * (n - i) / (i + 1)).alias("c"), (a.s + a.c).alias("s"))
    up = F.aggregate(F.sequence(F.lit(0), m), F.struct(F.pow(F.lit(2.0), -n.cast("double")).alias("c"), F.lit(0.0).alias("s")), step, lambda a: a.s)
    back = lambda a, i: F.struct((a.c * i / (n - i + 1)).alias("c"), (a.s + a.c).alias("s"))
    log_top = _log_factorial(n) - F.when(m >= 100, _log_factorial(m)).otherwise(F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, i: s + F.when(i > 0, F.log(i.cast("double"))).otherwise(F.lit(0.0)))) - _log_factorial(n - m) - n * F.log(F.lit(2.0))
    down = F.exp(log_top) * F.aggregate(F.sequence(m, F.lit(0)), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")), back, lambda a: a.s)
    tail = F.when(n < 1000, up).otherwise(down)
    return F.when((k < 0) | (k > n), F.raise_error(F.lit("k must be in 0..n")).cast("double")).when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(outcomes: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    c = contingency(outcomes, a, b, *by)
    return c.select(
        "*", ((F.col("both") + F.col("a_only")) / F.col("n")).alias("acc_a"), ((F.col("both") + F.col("b_only")) / F.col("n")).alias("acc_b"),
        ((F.col("b_only") - F.col("a_only")) / F.col("n")).alias("delta"), binom_half(F.col("a_only"), F.col("discordant")).alias("p"),
    )


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """struct(lo, hi) within 0..1; (0, 0) for n <= 0."""
    p, d = successes / n, 1 + F.lit(z * z) / n
    middle, spread = (p + F.lit(z * z) / (2 * n)) / d, F.lit(z) / d * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    return F.when(n <= 0, zero).otherwise(F.struct(F.greatest(F.lit(0.0), middle - spread).alias("lo"), F.least(F.lit(1.0), middle + spread).alias("hi")))


def least_discordant(p: float = 0.05) -> int:
    """Smallest n whose most extreme split has p at most ``p``; at most 100."""
    return next((n for n in range(1, 101) if 2.0 ** (1 - n) <= p), 100)


def verdict(discordant: Column, p: Column) -> Column:
    return F.when(discordant < LEAST_DISCORDANT, UNDECIDABLE).when(p < 0.05, SIGNIFICANT).otherwise(F.lit(NOT_SIGNIFICANT))


def compare(outcomes: DataFrame, pairs: list[tuple[str, str]], tuned: tuple[str, ...] = ()) -> DataFrame:
    """One row a pair of strategies; a pair with a tuned strategy is tested on the rows of split ``test`` alone."""
    out = None
    for a, b in pairs:
        rows = outcomes.where("split = 'test'") if {a, b} & set(tuned) else outcomes
        one = mcnemar(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", verdict(F.col("discordant"), F.col("p")))
