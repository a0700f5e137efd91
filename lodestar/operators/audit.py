"""Audits of extracted relations and the re-scoring that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.stats import wilson
from lodestar.plans.lineage import numbered

CENSUS = 150


def plan_audit(populations: DataFrame, limit: int = CENSUS) -> DataFrame:
    """(rtype, population, mode, k): all rows of a small population, else a sample of ``limit``."""
    small = F.col("population") <= limit
    return populations.select("rtype", "population", F.when(small, "census").otherwise(F.lit("sample")).alias("mode"), F.when(small, F.col("population")).otherwise(F.lit(limit)).alias("k"))


def systematic_sample(rows: DataFrame, k: int, order: list[str | Column], *by: str) -> DataFrame:
    """Rows int(i * N / k) for i < k in the given order, of all rows or of each group; all if k >= N."""
    if by:
        w = Window.partitionBy(*by)
        marked = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    else:
        marked = numbered(rows, order, "__i").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__n"))))  # one row
    # row j is taken if some i has int(i * (N / k)) = j: the least i with i * (N / k) >= j, or one less by rounding
    step = F.col("__n").cast("double") / F.lit(float(k))
    guess = F.floor(F.col("__i") / step)
    hit = F.lit(False)
    for d in (0, 1):
        i = guess + d
        hit = hit | ((i >= 0) & (i < k) & (F.floor(i * step) == F.col("__i")))
    return marked.where((F.col("__n") <= k) | hit).drop("__i", "__n")


def precision(labels: DataFrame, sampled: Column, *by: str) -> DataFrame:
    """(by, n, ok, precision, lo, hi): the interval only where rows were sampled."""
    one = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "ok").alias("ok"), F.first(sampled).alias("sampled"))
    w = wilson(F.col("ok"), F.col("n"))
    return one.select(*by, "n", "ok", (F.col("ok") / F.col("n")).alias("precision"), F.when(F.col("sampled"), w["lo"]).alias("lo"), F.when(F.col("sampled"), w["hi"]).alias("hi"))


def invalid_keys(labels: DataFrame) -> DataFrame:
    """Keys labelled bad; a missing label is not bad."""
    return labels.where("label = 'bad'").select("key").distinct()


def purify(queries: DataFrame, invalid: DataFrame) -> DataFrame:
    """Queries (qid, sources, ...) none of whose sources is invalid; one without sources stays."""
    bad = queries.select("qid", F.explode("sources").alias("key")).join(invalid, "key", "left_semi").select("qid").distinct()
    return queries.join(bad, "qid", "left_anti")


def score(queries: DataFrame, outcomes: DataFrame, strategies: DataFrame, *by: str) -> DataFrame:
    """(strategy, by, n, accuracy) from stored outcomes; a missing one is wrong."""
    every = queries.select("qid", *by).crossJoin(strategies)  # a few strategies
    rows = every.join(outcomes.select("qid", "strategy", "correct"), ["qid", "strategy"], "left")
    return rows.groupBy("strategy", *by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("correct", F.lit(False)).cast("double")).alias("accuracy"))


def before_after(queries: DataFrame, invalid: DataFrame, outcomes: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy, before, after, delta, dropped)."""
    clean = purify(queries, invalid)
    a = score(queries, outcomes, strategies).select("strategy", F.col("n").alias("na"), F.col("accuracy").alias("before"))
    b = score(clean, outcomes, strategies).select("strategy", F.col("n").alias("nb"), F.col("accuracy").alias("after"))
    return a.join(b, "strategy", "left").select("strategy", "before", "after", (F.col("after") - F.col("before")).alias("delta"), (F.col("na") - F.coalesce("nb", F.lit(0))).alias("dropped"))


def duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(hash, copies, first_id) of texts that occur more than once."""
    h = docs.select(F.sha2(F.col(text_col), 256).alias("hash"), F.col(id_col).alias("id"))
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")
