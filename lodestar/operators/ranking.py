"""Ranking, fusion and iterative retrieval over tables (qid, chunk_id, score)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import graph, segments
from lodestar.operators.dense import Formula, blend_topk
from lodestar.operators.lexical import LexicalIndex, components
from lodestar.plans.lineage import cut

#: Share of the dense score in hybrid scores, and of the graph score in fused ones.
DENSE_WEIGHT, GRAPH_WEIGHT = 0.9, 0.5
KEYS = ["qid", "chunk_id"]
#: Digits that scores are compared at: sums in another order agree to these.
PLACES = 9


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Adds ``rank``: scores descending, ties to the smaller chunk id; the first ``k``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", PLACES)), "chunk_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def reached_topk(seeds: DataFrame, relations: DataFrame, hops: int, of: DataFrame, score: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): the ``k`` best by ``score`` of what a search reaches, if it reads no entities but those of ``of`` (eid).

    Queries that reach these alike are searched, scored and ranked once.
    """
    same = cut(graph.alike(seeds, relations, of))
    best = top_k(score(graph.expand(graph.first_of(seeds, same), relations, hops)), k)
    return graph.to_all(cut(best), same)


def retrieved(ranked: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One array of chunk ids a query, in order of rank."""
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].alias("retrieved"))


def normalize(scores: DataFrame) -> DataFrame:
    """By the largest score of the query, found with map-side combining; all 0 if that is not above 0."""
    top = scores.groupBy("qid").agg(F.max("score").alias("top"))
    return scores.join(top, "qid").select(*KEYS, F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.lit(0.0)).alias("score"))


def weighted(a: DataFrame, b: DataFrame, wa: float | Column, wb: float | Column) -> DataFrame:
    """wa * a + wb * b on the union of their pairs; an absent score is 0."""
    wa, wb = (x if isinstance(x, Column) else F.lit(float(x)) for x in (wa, wb))
    x, y = a.select(*KEYS, F.col("score").alias("a")), b.select(*KEYS, F.col("score").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.join(y, KEYS, "full_outer").select(*KEYS, (wa * zero("a") + wb * zero("b")).alias("score"))


#: Formulas over the product and the parts (bm25, keyword) of ``Scores``.
PARTS = ("bm25", "keyword")
MODES = {
    "hybrid": Formula(DENSE_WEIGHT, (1 - DENSE_WEIGHT, None)), "bm25_only": Formula(None, (1.0, None)),
    "dense_only": Formula(1.0, (None, None)), "keyword_fallback": Formula(None, (None, 1.0)),
}


@dataclass(frozen=True)
class Scores:
    """What all strategies are made of, scored once: ``queries`` (qid, q), ``vectors`` (chunk_id, v) and ``met`` (qid, chunk_id, bm25, keyword), a table."""

    queries: DataFrame
    vectors: DataFrame
    met: DataFrame

    def top(self, formulas: dict[str, Formula], k: int) -> DataFrame:
        """(formula, qid, chunk_id, score, rank) by all the formulas, in one pass."""
        return blend_topk(self.queries, self.vectors, formulas, k, self.met, PARTS)


def scores_of(index: LexicalIndex, questions: DataFrame, vectors: DataFrame | None = None, encoded: DataFrame | None = None) -> Scores:
    """Scores of (qid, question): ``encoded`` (qid, q) has the vectors of those that have one."""
    met = cut(components(index, questions))
    asked = questions.select("qid")
    if encoded is None or vectors is None:
        spark = questions.sparkSession
        kind = index.chunks.schema["chunk_id"].dataType.simpleString()
        return Scores(asked.withColumn("q", F.lit(None).cast("array<double>")), spark.createDataFrame([], f"chunk_id {kind}, v array<float>"), met)
    return Scores(asked.join(encoded.select("qid", "q"), "qid", "left"), vectors.select("chunk_id", "v"), met)


BM25, KEYWORD = Formula(None, (1.0, None)), Formula(None, (None, 1.0))


@dataclass(frozen=True)
class Retrieval:
    """What strategies need to rank without a table of pairs: segments, ``queries`` (qid, question, perhaps q) and ``vectors`` (chunk_id, v)."""

    index: segments.Segments
    queries: DataFrame
    vectors: DataFrame | None = None
    idf: str = "okapi"

    def raw(self, formulas: dict[str, Formula], k: int, scales: DataFrame | None = None) -> DataFrame:
        return segments.search(self.index, self.queries, formulas, k, self.vectors, scales, self.idf)

    def tops(self) -> DataFrame:
        """(qid, share): what a BM25 score is multiplied by to be a share of the largest of its query; 0 if that is not above 0."""
        best = self.raw({"bm25": BM25}, 1)
        return cut(best.select("qid", F.when(F.col("score") > 0, 1 / F.col("score")).otherwise(F.lit(0.0)).alias("share")))

    def top(self, formulas: dict[str, Formula], k: int, tops: DataFrame | None = None) -> DataFrame:
        """(formula, qid, chunk_id, score, rank) by all the formulas in one pass, with BM25 as a share of the largest of its query."""
        if not any(f.parts and f.parts[0] for f in formulas.values()):
            return self.raw(formulas, k)
        one = F.lit(1.0)
        names = F.explode(F.array(*[F.lit(f) for f in formulas]))
        return self.raw(formulas, k, (self.tops() if tops is None else tops).select("qid", names.alias("formula"), one.alias("d"), F.col("share").alias("b"), one.alias("s")))

    def pair_shares(self, pairs: DataFrame) -> DataFrame:
        """(qid, chunk_id, score): BM25 of chosen pairs as a share of the largest of the query."""
        found = segments.search(self.index, self.queries, {}, 1, idf=self.idf, pairs=pairs)
        return found.join(self.tops(), "qid").select(*KEYS, (F.col("score") * F.col("share")).alias("score"))

    def fused(self, k: int, flat: Formula = MODES["hybrid"], other: Formula = MODES["keyword_fallback"], weight: float = GRAPH_WEIGHT) -> DataFrame:
        """(qid, chunk_id, score, rank) of (1 - weight) * flat + weight * other, each by its largest of the query: the largest are found first, then all is one formula."""
        share = self.tops()
        best = self.top({"flat": flat, "other": other}, 1, share).groupBy("qid").agg(*[F.max(F.when(F.col("formula") == f, F.col("score"))).alias(f) for f in ("flat", "other")])
        scale = {f: F.when(F.col(f) > 0, w / F.col(f)).otherwise(F.lit(0.0)) for f, w in (("flat", 1 - weight), ("other", weight))}
        both = lambda a, b: scale["flat"] * F.lit(a or 0.0) + scale["other"] * F.lit(b or 0.0)
        parts = [both(a, b) for a, b in zip(flat.parts, other.parts, strict=True)]
        scales = cut(best.join(share, "qid", "left").select("qid", F.lit("fused").alias("formula"), both(flat.dense, other.dense).alias("d"), (parts[0] * F.coalesce("share", F.lit(0.0))).alias("b"), parts[1].alias("s")))
        one = lambda *w: 1.0 if any(x is not None for x in w) else None
        formula = Formula(one(flat.dense, other.dense), tuple(one(a, b) for a, b in zip(flat.parts, other.parts, strict=True)))
        return self.raw({"fused": formula}, k, scales).drop("formula")


def fused_topk(scores: Scores, k: int, flat: Formula = MODES["hybrid"], other: Formula = MODES["keyword_fallback"], weight: float = GRAPH_WEIGHT) -> DataFrame:
    """(qid, chunk_id, score, rank) of (1 - weight) * flat + weight * other, each by its largest of the query.

    The largest of each are found first; queries and parts are then scaled by them, so the fusion is one more formula.
    """
    tops = scores.top({"flat": flat, "other": other}, 1).groupBy("qid").agg(*[F.max(F.when(F.col("formula") == f, F.col("score"))).alias(f) for f in ("flat", "other")])
    tops = cut(tops)  # one row a query
    scale = {f: F.when(F.col(f) > 0, w / F.col(f)).otherwise(F.lit(0.0)) for f, w in (("flat", 1 - weight), ("other", weight))}
    dense = scale["flat"] * F.lit(flat.dense or 0.0) + scale["other"] * F.lit(other.dense or 0.0)
    queries = scores.queries.join(tops, "qid", "left").select("qid", F.transform("q", lambda x: x * F.coalesce(dense, F.lit(0.0))).alias("q"))
    parts = [(scale["flat"] * F.lit(flat.parts[m] or 0.0) + scale["other"] * F.lit(other.parts[m] or 0.0)) * F.col(c) for m, c in enumerate(PARTS)]
    met = scores.met.join(tops, "qid").select(*KEYS, *[x.alias(c) for x, c in zip(parts, PARTS, strict=True)])
    one = lambda *w: 1.0 if any(x is not None for x in w) else None
    both = Formula(one(flat.dense, other.dense), tuple(one(a, b) for a, b in zip(flat.parts, other.parts, strict=True)))
    return blend_topk(queries, scores.vectors, {"fused": both}, k, met, PARTS).drop("formula")


def hybrid_served(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int, weight: float = DENSE_WEIGHT) -> DataFrame:
    """The serving form of (qid, chunk_id, score) tables: candidates are the 2k best dense and all lexical hits, normalised; rounded, with the chunk's columns."""
    near, lex = top_k(dense, 2 * k).select(*KEYS, F.col("score").alias("d")), lexical.where("score > 0").select(*KEYS, F.col("score").alias("l"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = near.join(lex, KEYS, "full_outer").select(*KEYS, (weight * zero("d") + (1 - weight) * zero("l")).alias("score"), zero("d").alias("dense_score"), zero("l").alias("bm25_score"))
    best = top_k(both, k)
    rounded = best.select("qid", "rank", "chunk_id", *[F.round(c, 4).alias(c) for c in ("score", "dense_score", "bm25_score")], F.lit("hybrid").alias("mode"))
    return rounded.join(chunks, "chunk_id")


def mode_of(dense: bool, lexical: bool) -> str:
    """The best mode that the available parts allow."""
    return {(True, True): "hybrid", (False, True): "bm25_only", (True, False): "dense_only", (False, False): "keyword_fallback"}[dense, lexical]


def fused(flat: DataFrame, graph_scores: DataFrame, weight: float = GRAPH_WEIGHT) -> DataFrame:
    return weighted(normalize(flat), normalize(graph_scores), 1 - weight, weight)


def interleave(rounds: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Round robin over (qid, round, rank, chunk_id): first places of all rounds, then second ones; repeats go."""
    first = F.row_number().over(Window.partitionBy(*by, "chunk_id").orderBy("rank", "round"))
    once = rounds.withColumn("nth", first).where("nth = 1").drop("nth")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "round"))
    return once.withColumn("place", place).where(F.col("place") <= k).select(*by, F.col("place").alias("rank"), "chunk_id")


def iterate(seeds: DataFrame, flat: DataFrame, relations: DataFrame, relations_of: DataFrame, rounds: int = 2, per_round: int = 3, hops: int = 2, weight: float = GRAPH_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Iterative retrieval of all queries at once: (qid, round, rank, chunk_id) and the trace (qid, round, eid).

    A round ranks chunks by the fusion of ``flat`` scores with relation scores
    around the round's seeds. The next seeds are the far ends of relations that
    the round's best chunk states and that touch a seed, as far as they are new.
    A query without new seeds is done. Only whether any query goes on comes to
    the driver.
    """
    base = normalize(flat)
    now = cut(seeds.select("qid", "eid").distinct())
    seen, out, trace = now, None, now.withColumn("round", F.lit(1))
    for number in range(1, rounds + 1):
        scores = normalize(graph.relation_scores(graph.expand(now, relations, hops), relations_of))
        own = base.join(now.select("qid").distinct(), "qid", "left_semi") if number > 1 else base
        best = top_k(weighted(own, scores, 1 - weight, weight), per_round).select("qid", F.lit(number).alias("round"), "rank", "chunk_id")
        best = cut(best)
        out = best if out is None else out.unionByName(best)
        if number == rounds:
            break
        ends = best.where("rank = 1").join(relations_of, "chunk_id").select("qid", F.explode(F.array(F.struct(F.col("head").alias("near"), F.col("tail").alias("far")), F.struct(F.col("tail").alias("near"), F.col("head").alias("far")))).alias("e")).select("qid", "e.*")
        touch = now.withColumnRenamed("eid", "near")
        new = ends.join(touch, ["qid", "near"], "left_semi").select("qid", F.col("far").alias("eid")).distinct().join(seen, ["qid", "eid"], "left_anti")
        now = cut(new)
        if now.limit(1).count() == 0:
            break
        seen = seen.unionByName(now)
        trace = trace.unionByName(now.withColumn("round", F.lit(number + 1)))
    return out, trace


def trace_summary(found: DataFrame, trace: DataFrame) -> DataFrame:
    """(qid, rounds, retrieved, discovered)."""
    a = found.groupBy("qid").agg(F.max("round").alias("rounds"), F.count(F.lit(1)).alias("retrieved"))
    b = trace.where("round > 1").groupBy("qid").agg(F.count(F.lit(1)).alias("discovered"))
    return a.join(b, "qid", "left").withColumn("discovered", F.coalesce("discovered", F.lit(0)))


def sweep_rounds(found: DataFrame, gold: DataFrame, k: int, budgets: int = 4) -> DataFrame:
    """(budget, full_hit, avg_rounds) of 1..budgets rounds, from one run: a smaller budget is a prefix of its rounds."""
    grid = found.select(F.explode(F.sequence(F.lit(1), F.lit(budgets))).alias("budget"), "qid", "round", "rank", "chunk_id").where(F.col("round") <= F.col("budget"))
    used = grid.groupBy("budget", "qid").agg(F.max("round").alias("used"))
    lists = retrieved(interleave(grid, k, ("budget", "qid")), ("budget", "qid"))
    ok = F.size(F.array_except("gold", "retrieved")) == 0
    rows = lists.join(gold.select("qid", "gold"), "qid").join(used, ["budget", "qid"])
    return rows.groupBy("budget").agg(F.avg(ok.cast("double")).alias("full_hit"), F.avg("used").alias("avg_rounds"))


def sweep_weights(scores: Scores | Retrieval, gold: DataFrame, k: int, steps: int = 10) -> DataFrame:
    """(w, full_hit, mrr) for w = 0, 1/steps, ... 1: every weight is a formula over the same scores, in one pass."""
    formulas = {str(s): Formula(s / steps, (1 - s / steps, None)) for s in range(steps + 1)}
    ranked = scores.top(formulas, k).withColumn("step", F.col("formula").cast("int"))
    lists = retrieved(ranked, ("step", "qid")).join(gold.select("qid", "gold"), "qid")
    places = F.filter(F.transform("gold", lambda g: F.array_position("retrieved", g)), lambda p: p > 0)
    return lists.groupBy("step").agg(
        F.avg((F.size(F.array_except("gold", "retrieved")) == 0).cast("double")).alias("full_hit"),
        F.avg(F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(F.lit(0.0))).alias("mrr"),
    ).select((F.col("step") / F.lit(float(steps))).alias("w"), "full_hit", "mrr")


def choose_weight(sweep: DataFrame) -> DataFrame:
    """The weight of the largest full_hit, the smaller of equals: one row."""
    return sweep.agg(F.max_by("w", F.struct("full_hit", -F.col("w"))).alias("w"), F.max("full_hit").alias("full_hit"))


def rerank(candidates: DataFrame, pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int, depth: int = 20) -> DataFrame:
    """Best ``k`` of the first ``depth`` candidates by an injected scorer of (question, text); ties keep their order.

    The candidates are cut to ``depth`` before the scorer, which runs on Arrow batches.
    """

    @F.pandas_udf("double")
    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(question, text, strict=True))), dtype="float64")

    few = candidates.where(F.col("rank") <= depth).join(pairs, KEYS).withColumnRenamed("rank", "before")
    scored = few.withColumn("score", run("question", "text"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "before"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def rerank_bound(ranked: DataFrame, gold: DataFrame, k: int = 3, depth: int = 20) -> DataFrame:
    """(qid, now, reachable): whether all gold is in the first ``k``, and in the first ``depth`` that a reranker sees."""
    near = ranked.where(F.col("rank") <= depth).groupBy("qid").agg(F.collect_list(F.struct("rank", "chunk_id")).alias("r"))
    ids = lambda n: F.transform(F.filter("r", lambda x: x.rank <= n), lambda x: x.chunk_id)
    hit = lambda n: F.size(F.array_except("gold", F.coalesce(ids(n), F.array().cast("array<string>")))) == 0
    return gold.select("qid", "gold").join(near, "qid", "left").select("qid", hit(k).alias("now"), hit(depth).alias("reachable"))


def fan_out(lists: dict[str, DataFrame]) -> DataFrame:
    """Results of several strategies in one table; what is scored once for all of them is ``Scores``."""
    out = None
    for name, df in lists.items():
        part = df.withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def export_by(lists: DataFrame, key: str) -> DataFrame:
    """(key, by_query): a map of query to list, for a static export."""
    entry = F.struct(F.col("qid").alias("k"), F.col("retrieved").alias("v"))
    return lists.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_query"))
