"""Lexical scoring over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import number_set, tokens
from lodestar.plans.lineage import cut

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` (term, chunk_id, tf, dl), ``terms`` (term, df, idf) and ``stats`` (n, avgdl), one row."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    chunks: DataFrame


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", idf: str = "okapi") -> LexicalIndex:
    """Indexes (id, text). ``idf`` is ``okapi``, with negative values floored at a quarter of the mean, or ``lucene``.

    Terms of a chunk are counted in the task that reads it, so only counted
    postings are shuffled; the length of the chunk travels with each posting,
    which saves a join when scoring. Postings are written as a table, since
    document frequencies, means and scores all read them.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.col(text_col)).alias("toks"))
    postings = cut(
        rows.select("chunk_id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term"))
        .groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    )
    # the number of chunks needs no text, and all else comes from the postings
    ids = chunks.select(F.col(id_col).alias("chunk_id"))
    per_term = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    stats = n.crossJoin(per_term.agg(F.sum("cf").alias("total"))).select("n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))  # tables of one row
    df = per_term.select("term", "df").crossJoin(F.broadcast(n))  # one row
    if idf == "lucene":
        terms = df.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    else:
        raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
        terms = raw.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")))  # one row
    return LexicalIndex(postings, terms.select("term", "df", "idf"), stats, ids)


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "question") -> DataFrame:
    """(qid, term, qtf): a token that repeats counts as often."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(index: LexicalIndex, queries: DataFrame, id_col: str = "qid", text_col: str = "question") -> DataFrame:
    """(qid, chunk_id, score) of the chunks that share a term with the query."""
    asked = query_terms(queries, id_col, text_col).join(index.terms, "term")
    met = index.postings.join(asked, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))


def components(index: LexicalIndex, queries: DataFrame, id_col: str = "qid", text_col: str = "question") -> DataFrame:
    """(qid, chunk_id, bm25, keyword) of the pairs that share a term, from one pass over the postings.

    ``bm25`` is by the largest of its query, or 0 where that is not above 0;
    ``keyword`` is the number of distinct shared tokens. The table is written
    once, so that every fusion, sweep and fallback reads the same scores.
    """
    asked = query_terms(queries, id_col, text_col).join(index.terms, "term")
    met = index.postings.join(asked, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = cut(met.groupBy("qid", "chunk_id").agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).cast("double").alias("keyword")))
    top = scores.groupBy("qid").agg(F.max("bm25").alias("top"))
    share = F.when(F.col("top") > 0, F.col("bm25") / F.col("top")).otherwise(F.lit(0.0))
    return scores.join(top, "qid").select("qid", "chunk_id", share.alias("bm25"), "keyword")


def complete(scores: DataFrame, queries: DataFrame, chunks: DataFrame, id_col: str = "qid") -> DataFrame:
    """Every chunk for every query, with 0 where there is no score: for small tables, ``dense.blend_topk`` needs no such table."""
    every = queries.select(F.col(id_col).alias("qid")).distinct().crossJoin(chunks.select("chunk_id").distinct())
    return every.join(scores, ["qid", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def max_normalized(scores: DataFrame) -> DataFrame:
    """Scores by the largest of their query, where that is above 0."""
    top = scores.groupBy("qid").agg(F.max("score").alias("top"))
    return scores.join(top, "qid").select("qid", "chunk_id", (F.col("score") / F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0))).alias("score"))


def keyword_overlap(chunks: DataFrame, queries: DataFrame, id_col: str = "qid", text_col: str = "question") -> DataFrame:
    """(qid, chunk_id, score): distinct shared tokens; pairs without one are absent."""
    words = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = queries.select(F.col(id_col).alias("qid"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return words.join(asked, "term").groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def index_stats(chunks: DataFrame) -> DataFrame:
    n = F.size(tokens(F.col("text")))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))


def sparse_scores(chunk_weights: DataFrame, query_weights: DataFrame) -> DataFrame:
    """Dot products of exploded sparse vectors (chunk_id, dim, w) and (qid, dim, w), by the largest of each query."""
    met = chunk_weights.withColumnRenamed("w", "cw").join(query_weights.withColumnRenamed("w", "qw"), "dim")
    return max_normalized(met.groupBy("qid", "chunk_id").agg(F.sum(F.col("cw") * F.col("qw")).alias("score")))


def number_support(answer, contexts):
    """Share of the answer's numbers that the contexts hold; without numbers 1."""
    asked, held = number_set(answer), number_set(F.array_join(contexts, "\n"))
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(asked, held)) / F.size(asked))
