"""Answers, judges and the tables that a console shows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.needles import matches
from lodestar.functions.text import strip

#: Texts of rule-based answers.
NOTHING_FOUND = "관련 문서를 찾을 수 없습니다."
ANSWER_FORM = "[%s / 페이지 %d] 관련 내용:\n\n%s\n\n(※ Ollama 미연결 — Rule-based 폴백)"
RULE = "\n\n---\n\n"


def assemble_context(ranked: DataFrame) -> DataFrame:
    """(qid, context) from (qid, rank, doc_name, page_num, text): numbered blocks joined by a rule."""
    block = F.format_string("[문서 %d: %s / 페이지 %d]\n%s", F.col("rank"), F.col("doc_name"), F.col("page_num") + 1, F.col("text"))
    rows = ranked.select("qid", F.struct("rank", block.alias("block")).alias("b")).groupBy("qid").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return rows.select("qid", F.array_join(F.transform("b", lambda x: x.block), RULE).alias("context"))


def rule_answers(queries: DataFrame, ranked: DataFrame, most: int = 600) -> DataFrame:
    """(qid, answer): the first ``most`` characters of the best chunk, or that nothing was found."""
    best = ranked.where("rank = 1").select("qid", F.format_string(ANSWER_FORM, F.col("doc_name"), F.col("page_num") + 1, F.left("text", F.lit(most))).alias("answer"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce("answer", F.lit(NOTHING_FOUND)).alias("answer"))


def split_claims(answer: Column) -> Column:
    """Statements between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "[.。]"), lambda x: strip(x)), lambda x: x != "")


def stub_supported(statement: Column, contexts: Column) -> Column:
    """The deterministic judge: the statement's first word occurs in the contexts."""
    return F.array_join(contexts, "\n").contains(F.split(strip(statement), r"\s+")[0])


def stub_faithfulness(rows: DataFrame) -> DataFrame:
    """Adds claims and faithfulness (1 without claims) by the deterministic judge; columns alone."""
    claims = split_claims(F.col("answer"))
    ok = F.size(F.filter(claims, lambda c: stub_supported(c, F.col("contexts"))))
    return rows.select("*", claims.alias("claims"), F.when(F.size(claims) > 0, ok / F.size(claims)).otherwise(F.lit(1.0)).alias("faithfulness"))


def judged_faithfulness(rows: DataFrame, judge: Callable[[str, str], bool], prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """(item_id, claims, supported, faithfulness) with an injected judge (statement, context), called on Arrow batches."""
    ready = prepare or (lambda c: c)

    @F.pandas_udf("boolean")
    def ask(statement: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([bool(judge(s, c)) for s, c in zip(statement, context, strict=True)])

    base = rows.select("item_id", ready(F.col("answer")).alias("answer"), ready(F.array_join("contexts", "\n")).alias("context"))
    claims = base.select("item_id", "context", F.posexplode(split_claims(F.col("answer"))).alias("nth", "claim"))
    n = claims.withColumn("ok", ask("claim", "context")).groupBy("item_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("ok").alias("supported"))
    out = rows.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("supported", F.lit(0)).alias("supported"))
    return out.withColumn("faithfulness", F.when(F.col("claims") > 0, F.col("supported") / F.col("claims")).otherwise(F.lit(1.0)))


def holding(rows: DataFrame, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """The pairs of a row, without its text, and a needle that its text contains: ``start`` is where it does first."""
    return matches(rows, text_col, needles, needle_col, first=True)


def find_document(docs: DataFrame, triples: DataFrame, query: str) -> DataFrame:
    """Triples and evidence of the first document whose project or agency contains ``query``."""
    first = docs.where(F.col("project").contains(query) | F.col("agency").contains(query)).orderBy("doc_id").limit(1)
    return triples.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "seq", "head", "rtype", "tail", "evidence")


def badges(ranked: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, rank, chunk_id, badge): gold, distractor, wrong, or unlabelled for a query without gold."""
    marked = ranked.join(chunks.select("chunk_id", (F.size("states") == 0).alias("bare")), "chunk_id", "left").join(gold.select("qid", "gold"), "qid", "left")
    badge = F.when(F.col("gold").isNull(), "unlabelled").when(F.array_contains("gold", F.col("chunk_id")), "gold").when(F.col("bare"), "distractor").otherwise(F.lit("wrong"))
    return marked.select("qid", "rank", "chunk_id", badge.alias("badge"))
