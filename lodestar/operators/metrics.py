"""Retrieval, answer and judge metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import answer_tokens
from lodestar.functions.vectors import cosine
from lodestar.plans.lineage import cut


def _checked(gold: Column) -> Column:
    return F.when(F.size(gold) > 0, gold).otherwise(F.raise_error(F.lit("gold is empty")).cast("array<string>"))


def hit(ret: Column, gold: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ret, 1, k), gold).cast("double")


def full_hit(ret: Column, gold: Column, k: int) -> Column:
    return (F.size(F.array_except(gold, F.slice(ret, 1, k))) == 0).cast("double")


def reciprocal_rank(ret: Column, gold: Column) -> Column:
    """Of the best gold in the whole list."""
    places = F.filter(F.transform(gold, lambda g: F.array_position(ret, g)), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.lit(1.0) / F.array_min(places)).otherwise(F.lit(0.0))


def recall(ret: Column, gold: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.array_distinct(gold), F.slice(ret, 1, k))) / F.size(F.array_distinct(gold))


def per_query(lists: DataFrame, gold: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """Metrics of each (qid, retrieved) against (qid, gold, ...); an empty gold raises when read."""
    rows = lists.join(gold, "qid")
    if strict:
        rows = rows.withColumn("gold", _checked(F.col("gold")))
    r, g = F.col("retrieved"), F.col("gold")
    return rows.select("*", hit(r, g, k).alias("hit"), full_hit(r, g, k).alias("full_hit"), reciprocal_rank(r, g).alias("rr"), recall(r, g, k).alias("recall"))


_MEANS = [("hit", "hit"), ("full_hit", "full_hit"), ("rr", "mrr"), ("recall", "recall")]


def aggregate(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, means of the metrics); without rows and ``by``, zeros."""
    means = [F.coalesce(F.avg(a), F.lit(0.0)).alias(b) for a, b in _MEANS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *means)


def by_hops(rows: DataFrame) -> DataFrame:
    """(strategy, hops, ...): each strategy over all queries (hops null) and by hops, in one pass."""
    rows.createOrReplaceTempView("__by_hops")
    means = ", ".join(f"avg({a}) AS {b}" for a, b in _MEANS)
    return rows.sparkSession.sql(f"SELECT strategy, hops, count(*) AS n, {means} FROM __by_hops GROUP BY GROUPING SETS ((strategy), (strategy, hops))")


def at_depths(lists: DataFrame, gold: DataFrame, depths: int = 3) -> DataFrame:
    """(k, n, hit_rate, mrr) for k = 1..depths."""
    rows = lists.join(gold, "qid").select("*", F.explode(F.sequence(F.lit(1), F.lit(depths))).alias("k"))
    near = F.slice(F.col("retrieved"), F.lit(1), F.col("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(F.arrays_overlap(near, F.col("gold")).cast("double")).alias("hit_rate"), F.avg(reciprocal_rank(near, F.col("gold"))).alias("mrr"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of token multisets; 0 if they share nothing."""
    x, y = answer_tokens(a), answer_tokens(b)
    times = lambda toks, t: F.size(F.filter(toks, lambda u: u == t))
    both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, t: s + F.least(times(x, t), times(y, t)))
    return F.when(both > 0, 2.0 * both / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def token_f1_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, f1) of (pair_id, a, b) by joined token counts: for long texts, where a fold would be quadratic."""
    count = lambda c: pairs.select("pair_id", F.explode(answer_tokens(F.col(c))).alias("tok")).groupBy("pair_id", "tok").agg(F.count(F.lit(1)).alias(f"n{c}"))
    met = count("a").join(count("b"), ["pair_id", "tok"]).groupBy("pair_id").agg(F.sum(F.least("na", "nb")).alias("both"))
    sizes = pairs.select("pair_id", (F.size(answer_tokens(F.col("a"))) + F.size(answer_tokens(F.col("b")))).alias("sizes"))
    return sizes.join(met, "pair_id", "left").select("pair_id", F.when(F.col("both") > 0, 2.0 * F.col("both") / F.col("sizes")).otherwise(F.lit(0.0)).alias("f1"))


def context_precision(relevance: Column) -> Column:
    """Mean precision at the places of relevant contexts; 0 if none is relevant."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("acc"), F.lit(0).alias("k"))
    step = lambda s, x: F.struct(
        (s.hits + F.when(x > 0, 1).otherwise(0)).alias("hits"), (s.acc + F.when(x > 0, (s.hits + 1) / (s.k + 1)).otherwise(F.lit(0.0))).alias("acc"), (s.k + 1).alias("k"),
    )
    return F.aggregate(relevance, start, step, lambda s: F.when(s.hits > 0, s.acc / s.hits).otherwise(F.lit(0.0)))


def mean_or(values: Column, default: float) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(default))


def context_recall(found: Column) -> Column:
    return mean_or(found, 0.0)


def faithfulness(supported: Column) -> Column:
    return mean_or(supported, 1.0)


def answer_relevancy(question: Column, generated: Column) -> Column:
    """Mean cosine of the question's vector with those of generated questions; 0 without any."""
    return mean_or(F.transform(generated, lambda g: cosine(question, g)), 0.0)


def auroc(rows: DataFrame, score: str = "score", label: str = "label", *by: str) -> DataFrame:
    """(by, auroc): chance that a positive row (label 1) scores below a negative one, ties half; null if a side is empty.

    From mid-ranks by counts of each score, so no pair of rows is made.
    """
    counts = rows.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    above = F.sum("q").over(Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1))
    part = counts.withColumn("above", F.coalesce(above, F.lit(0)))
    won = F.sum(F.col("p") * (F.col("above") + 0.5 * F.col("q")))
    return part.groupBy(*by).agg((won / F.when(F.sum("p") * F.sum("q") > 0, F.sum("p") * F.sum("q"))).alias("auroc"))


def element(values: Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values: no interpolation."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.floor(F.size(s) * F.lit(share)).cast("int"), F.size(s) - 1))


#: Ranges of equal width that values are counted in, and how often a range is divided before its values are.
RANGES, DIVIDED = 1024, 2


def at_share(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Means and elements at shares of each group, without sorting values.

    Values are counted in ``RANGES`` ranges of each group, on the map side; the
    range in which an element lies is divided again, and only the
    different values of the last range are put in order. Ranges are cut at values that occur, so
    a group of one value, or of many equal ones, ends at once.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    size = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * F.lit(float(s))), F.col("n") - 1).alias("left")) for name, s in shares.items()])).alias("w")
    sought = size.select(*by, wanted, "lo", "hi").select(*by, "w.name", "w.left", "lo", "hi")
    keys = [*by, "name"]

    def inside(sought: DataFrame, slot: Column) -> DataFrame:
        """(keys, slot, c, low, high, left, before) of the values from lo to hi of each element that is sought."""
        met = own.join(sought, list(by)) if by else own.crossJoin(F.broadcast(sought))  # without groups, a row an element
        counts = met.where(F.col("__v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, slot.alias("slot")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.first("left").alias("left"))
        before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        return placed.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))

    width = (F.col("__v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
    for _ in range(DIVIDED):
        slot = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RANGES - 1), F.floor(width * RANGES))).otherwise(F.lit(0))
        sought = cut(inside(sought, slot).select(*keys, (F.col("left") - F.col("before")).alias("left"), F.col("low").alias("lo"), F.col("high").alias("hi")))
    wide = inside(sought, F.col("__v")).groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in shares])
    size = size.select(*by, "n", "mean")
    return (size.join(wide, list(by)) if by else size.crossJoin(wide)).select(*by, "n", "mean", *shares)  # without groups, one row each


def judge_summary(rows: DataFrame) -> DataFrame:
    """One row from judge rows: recall, false alarm, precision, AUROC, errors and the middle latency."""
    good = rows.where("error is null")
    pos, neg = F.col("hallucinated") == 1, F.col("hallucinated") == 0
    share = lambda a, b: F.count_if(a) / F.when(F.count_if(b) > 0, F.count_if(b))
    flag = F.col("flagged") == 1
    one = good.agg(
        F.count(F.lit(1)).alias("n"), share(pos & flag, pos).alias("recall"), share(neg & flag, neg).alias("false_alarm"), share(pos & flag, flag).alias("precision"),
    )
    n_errors = rows.agg(F.count_if(F.col("error").isNotNull()).alias("errors"))
    return one.crossJoin(auroc(good, "score", "hallucinated")).crossJoin(n_errors).crossJoin(at_share(good, "ms", {"p50": 0.5}).select("p50"))  # tables of one row


def judge_by_variant(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("flagged").alias("flagged"), F.round(F.avg("score"), 3).alias("mean_score"))


def flips(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: items judged twice and those whose flag changed."""
    both = first.select("item_id", F.col("flagged").alias("a")).join(second.select("item_id", F.col("flagged").alias("b")), "item_id")
    return both.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("a") != F.col("b")).alias("flips"))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Interpolated P50 and P95."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def count_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def content_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), F.avg("char_count").alias("mean_chars"), F.avg(F.col("has_table").cast("double")).alias("with_table"))
