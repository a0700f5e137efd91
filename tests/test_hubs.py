"""Searches and questions around hubs: the same as each on its own, and work that grows with the rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, evalset, extract, graph, ranking
from tests.test_operators import plain_expand, relations

STAR = [("hub", "R", f"leaf{i}") for i in range(40)] + [("hub", "R", "mid"), ("mid", "R", "end")]


def mixed(seed=3):
    rng = random.Random(seed)
    edges = STAR + [(f"e{rng.randrange(30)}", "R", f"e{rng.randrange(30)}") for _ in range(40)]
    seeds = [(q, f"leaf{q}") for q in range(40)] + [(q, f"e{rng.randrange(35)}") for q in range(40, 90) for _ in range(2)] + [(90, "leaf1"), (91, "leaf1"), (91, "unknown")]
    return edges, seeds


@pytest.mark.parametrize("made", [1 << 22, 20])
def test_shared_searches_are_whole(spark, monkeypatch, made):
    """all forms find what each search finds on its own, in whatever pieces rows are made."""
    monkeypatch.setattr(graph, "MADE", made)
    edges, seeds = mixed()
    want = {(q, e): d for q in {q for q, _ in seeds} for e, d in plain_expand(edges, [s for i, s in seeds if i == q], 2).items()}
    s, r = spark.createDataFrame(seeds, "qid long, eid string"), relations(spark, edges)
    for form in (graph.expand, graph.expand_paths):
        rows = form(s, r, 2).collect()
        assert {(x.qid, x.eid): x.dist for x in rows} == want and len(rows) == len(want)


def test_recursion_has_no_limit_of_rows(spark):
    edges, seeds = mixed()
    s, r = spark.createDataFrame(seeds, "qid long, eid string"), relations(spark, edges)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "30")
    try:
        assert graph.differences(graph.expand(s, r, 3), graph.expand_recursive(s, r, 3)).count() == 0
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_backends_are_compared_by_searches(spark, monkeypatch):
    """F16: a search that differs counts for each query that shares it, but not at its own seeds."""
    edges, seeds = mixed()
    s, r = spark.createDataFrame(seeds, "qid long, eid string"), relations(spark, edges)
    assert graph.backends_differ(s, r, 2).count() == 0
    whole = graph._paths
    monkeypatch.setattr(graph, "_paths", lambda a, b, hops: whole(a, b, hops).where("eid <> 'leaf1'"))
    assert {x.qid for x in graph.backends_differ(s, r, 2).collect()} == set(range(40)) - {1}


def test_leaves_of_a_hub_are_searched_once(spark):
    """A leaf that chunks name is a class of its own, the others are one; scores are those of each alone."""
    edges, seeds = mixed()
    s, r = spark.createDataFrame(seeds, "qid long, eid string"), relations(spark, edges)
    of = spark.createDataFrame([(f"c{i}", e) for i, e in enumerate(["hub", "mid", "leaf7", "leaf1", "e3", "e4", "e5", "hub"])], "chunk_id string, eid string")
    same = {x.qid: x.like for x in graph.alike(s, r, of).collect()}
    assert {same[q] for q in range(40) if q not in (1, 7)} == {0} and same[7] == 7 and same[1] == same[90] == 1
    score = lambda dist: graph.mention_scores(dist, of)
    got = ranking.reached_topk(s, r, 2, of, score, 3)
    want = ranking.top_k(score(graph.expand(s, r, 2)), 3)
    assert sorted(map(tuple, got.select("qid", "chunk_id", "rank").collect())) == sorted(map(tuple, want.select("qid", "chunk_id", "rank").collect()))


def test_steps_meet_only_where_questions_may_be(spark):
    """40 leaves of a hub make one question each, by way of the hub to its one parent; its 40 leaves are too many."""
    rows = [("top", "CONTAINS", "hub")] + [("hub", "CONTAINS", f"leaf{i}") for i in range(40)] + [("few", "CONTAINS", x) for x in ("a", "b", "c")]
    r = relations(spark, rows)
    home = r.withColumn("chunk_id", F.concat(F.lit("page:"), F.col("tail")))
    names = r.select(F.explode(F.array("head", "tail")).alias("eid")).distinct().withColumn("name", F.col("eid"))
    of = home.select("chunk_id", F.explode(F.array("head", "tail")).alias("eid")).distinct()
    got = evalset.two_hop(graph.directed_edges(r), home, names, of, evalset.template_table(spark)).collect()
    assert {x.seeds[0]: tuple(x.gold) for x in got} == {f"leaf{i}": ("page:hub", f"page:leaf{i}") for i in range(40)} | {k: tuple(sorted(f"page:{x}" for x in "abc")) for k in "abc"}


def test_halves_of_each_number_of_hops(spark):
    q = spark.createDataFrame([(f"q{i:03d}", 1 + i % 3 // 2) for i in range(31)], "qid string, hops int")
    for hops in (1, 2):
        rows = sorted((x.qid, x.split) for x in evalset.split_holdout(q).where(F.col("hops") == hops).collect())
        assert [s for _, s in rows] == [("dev", "test")[i % 2] for i in range(len(rows))]


def test_names_with_one_beginning(spark, monkeypatch):
    """names meet where they stand, each once a question, with and without a broadcast."""
    names = [f"customer:{i}" for i in range(200)] + ["cu", "c", "물", "물레방"]
    asked = [(1, "customer:12 of customer:12 and customer:150"), (2, "물레방아 cu"), (3, ""), (4, "xcustomer:1")]
    want = sorted((q, n) for q, t in asked for n in names if n in t)
    for most in (0, 1000):
        monkeypatch.setattr(extract, "MOST_FORMS", most)
        got = extract.naming(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame([(n, n) for n in names], "eid string, name string"))
        assert sorted((x.qid, x.name) for x in got.select("qid", "name").collect()) == want and "eid" in got.columns


def test_best_of_cells(spark):
    """the best of a query's cell as by all pairs; of equal scores the smallest ids."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (600, 6)).astype(float)
    cell = rng.integers(0, 3, 600)
    rows = [(i, v[i].tolist(), int(cell[i]) if i % 50 else None) for i in range(600)]
    q, w = spark.createDataFrame(rows, "qid long, q array<double>, label int"), spark.createDataFrame(rows, "chunk_id long, v array<double>, label int")
    got = {(x.qid, x.rank): x.chunk_id for x in dense.exact_topk(q, w, 4, "label").collect()}
    want = {}
    for i in range(600):
        if i % 50:
            inside = [j for j in range(600) if j % 50 and cell[j] == cell[i]]
            want |= {(i, n + 1): j for n, j in enumerate(sorted(inside, key=lambda j: (-v[i] @ v[j], j))[:4])}
    assert got == want


def test_best_by_groups_is_best():
    rng = np.random.default_rng(1)
    score = rng.integers(0, 40, (50, 1000)) / 7.0
    score[:, ::9] = -np.inf
    score[3] = -np.inf
    i, j = dense._best(score, 6)
    for row in range(50):
        want = [c for c in sorted(range(1000), key=lambda c: (-score[row, c], c)) if np.isfinite(score[row, c])][:6]
        assert j[i == row].tolist() == want


def test_best_in_single_precision_is_decided_in_double(monkeypatch):
    """Products that differ by less than single precision holds, ties, a vector so long that all are in doubt, and values that are no number."""
    monkeypatch.setattr(dense, "TILE", 512)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1400, 6)).astype(np.float32).astype(float)
    close = base.copy()
    close[1:900] = base[0] + 1e-8 * rng.standard_normal((899, 6))
    equal = rng.integers(-1, 2, (1400, 6)).astype(float)
    long, odd = base.copy(), base.copy()
    long[7] *= 1e9
    odd[5, 0] = odd[9, 1] = np.nan
    for v in (base, close, equal, long, odd, base[:100], base[:3]):
        q = np.concatenate((v[:30], 1e-3 * base[:300]))
        asked = pa.table({"qid": pa.array(range(len(q) + 1)), "q": pa.array([*q.tolist(), None], pa.list_(pa.float64()))})
        ids = pa.array([f"c{i:04d}" for i in range(len(v))])
        for k in (1, 5):
            got = {}
            out = dense._nearest(k)(pa.table({"chunk_id": ids, "v": pa.array(v.tolist())}), asked)
            for i, c, s in zip(*(out[x].to_pylist() for x in ("qid", "chunk_id", "score")), strict=True):
                got.setdefault(i, []).append((int(c[1:]), s))
            for i in range(len(q)):
                score = (q[i] * v).sum(axis=1)
                want = [c for c in np.lexsort((np.arange(len(v)), -np.round(score, 9))).tolist() if np.isfinite(score[c])][:k]
                assert [c for c, _ in got.get(i, [])] == want
                assert [s for _, s in got.get(i, [])] == pytest.approx(score[want].tolist(), rel=1e-9, abs=1e-12)
            assert len(q) not in got


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("form", [graph.expand, graph.expand_paths, graph.expand_recursive])
def test_queries_of_a_hub_are_dealt_as_lists(spark, monkeypatch, form):
    """rows are not moved once for each piece of what a search reaches; seeds that many queries share."""
    monkeypatch.setattr(graph, "MADE", 1 << 12)
    monkeypatch.setattr(graph, "BLOCK", 64, raising=False)
    leaves = 1500
    r = relations(spark, [("hub", "R", f"leaf{i}") for i in range(leaves)])
    seeds = [(q, f"leaf{q}") for q in range(800)] + [(q, "leaf3") for q in range(700, 800)]
    s = spark.createDataFrame(seeds, "qid long, eid string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        begun = shuffled(spark)
        form(s, r, 2).write.format("noop").mode("overwrite").save()
        moved = shuffled(spark) - begun
        got = form(s, r, 2).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("eid").alias("eids"), F.sum("dist").alias("d")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    zeros = lambda q: 2 if q >= 700 else 1
    assert {x.qid: (x.n, x.eids, x.d) for x in got} == {q: (leaves + 1, leaves + 1, 1 + 2 * (leaves - zeros(q))) for q in range(800)}
    assert moved < 1_500_000
