"""What leaves the tasks that extract relations, and what the tables of a corpus read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import sentence_around
from lodestar.operators import chunking, extract


def _files(spark):
    text = "사업금액 3억원 미만은 나눈다\n사업비 : 1,200,000,000원\n적정 사업기간 산정기준 12개월 이내\n용역기간 : 30일 이내\nOracle 저장소"
    return spark.createDataFrame([("a", "기관_일.hwp", text), ("b", "이.hwp", None)], "doc_id string, filename string, text string")


def test_what_rules_void_leaves_no_task(spark):
    patterns = {"budget": extract.BUDGET_PATTERNS, "period": extract.PERIOD_PATTERNS}
    rows = extract.matches(_files(spark), patterns, {"budget": extract._good_budget, "period": extract._good_period}).collect()
    assert sorted((r["kind"], r["value"]) for r in rows) == [("budget", "1,200,000,000원"), ("period", "30일 이내")]
    assert sorted((r["kind"], r["value"]) for r in extract.facts(_files(spark)).collect()) == [("budget", "1,200,000,000원"), ("period", "30일 이내")]


def test_a_sentence_needs_no_splitting(spark):
    df = spark.createDataFrame([("하나. 둘 셋 넷! 다섯", 6, 7), ("셋", 0, 1), ("가-\n나\n다", 3, 4)], "t string, s int, e int").select(sentence_around(F.col("t"), F.col("s"), F.col("e")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["둘 셋 넷", "셋", "나"]
    assert "split(" not in df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_a_corpus_read_what_was_placed_once(spark):
    aliases = extract.alias_table(spark)
    corpus = chunking.build_corpus(_files(spark), extract.build_triples(_files(spark), aliases), aliases, size=40, overlap=0)
    assert corpus["home"].count() + corpus["unlinked"].count() == corpus["relations"].count() == 4
    for name in ("home", "entities", "relations", "unlinked"):
        plan = corpus[name]._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "InPandas" not in plan and "InArrow" not in plan
