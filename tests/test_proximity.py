"""The proximity graph against exact search."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, proximity
from lodestar.plans import registry


def clustered(n, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(4, n // 40), d))
    return centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, d))


def table(spark, x, names=("chunk_id", "v")):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{names[0]} long, {names[1]} array<float>").repartition(3)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize(("n", "part", "probes"), [(400, 16384, 4), (600, 60, 5), (600, 20, 8)])
def test_recall(spark, n, part, probes):
    x = clustered(n)
    index = proximity.build(table(spark, x), part)
    assert index.rows.count() == n and len(index.centres) == -(-n // part)
    got = {}
    for r in proximity.search(index, table(spark, x, ("qid", "q")), 8, (40,), probes).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    want = exact(x, 8)
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for i, rows in got.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 9)) and len({c for _, c, _ in rows}) == 8
        assert all(s == pytest.approx(u[i] @ u[c], abs=1e-5) for _, c, s in rows)
        hits += len({c for _, c, _ in rows} & set(want[i].tolist()))
    assert len(got) == n and hits >= 0.9 * 8 * n


def test_a_list_shorter_than_k(spark):
    x = clustered(200)
    found = proximity.search(proximity.build(table(spark, x)), table(spark, x, ("qid", "q")), 8, (1, 3, 8, 30)).groupBy("ef", "qid").count().groupBy("ef").agg(F.min("count"), F.max("count")).collect()
    assert {tuple(r) for r in found} == {(1, 1, 1), (3, 3, 3), (8, 8, 8), (30, 8, 8)}


def test_what_is_looked_at_grows_slower_than_the_vectors():
    share = []
    for n in (500, 2000, 8000):
        v = proximity._unit(clustered(n, 16).astype(np.float32))
        near = proximity.neighbours(v)
        place, _, looked = proximity.walk(v, near, v[:100], 30)
        best = np.argsort(-(v[:100] @ v.T), axis=1, kind="stable")[:, :10]
        assert np.mean([len(set(p.tolist()) & set(b.tolist())) for p, b in zip(place, best, strict=True)]) >= 9
        share.append(looked.mean() / n)
    assert share[1] < 0.6 * share[0] and share[2] < 0.6 * share[1] and share[2] < 0.1


def test_edges_lead_into_different_directions():
    v = proximity._unit(np.random.default_rng(2).standard_normal((300, 6)).astype(np.float32))
    near = proximity.neighbours(v)
    assert near.shape == (300, 2 * proximity.KEPT)
    for i, row in enumerate(near):
        own = row[row >= 0]
        assert len(own) and i not in own and len(set(own.tolist())) == len(own) and (row[len(own) :] == -1).all()
    assert proximity.neighbours(v[:1]).tolist() == [[-1] * 2 * proximity.KEPT]


def test_equal_vectors_and_one_cluster_that_holds_most(spark):
    x = np.concatenate((np.tile([1.0, 0.0, 0.0], (150, 1)), np.random.default_rng(4).standard_normal((50, 3))))
    index = proximity.build(table(spark, x), 20)
    assert max(r["count"] for r in index.rows.groupBy("part").count().collect()) <= 60
    got = proximity.search(index, table(spark, x[150:], ("qid", "q")), 3, (20,), 10).collect()
    assert len(got) == 150
    same = proximity.search(index, table(spark, x[:1], ("qid", "q")), 3, (200,), 10).collect()
    assert [r.score for r in same] == pytest.approx([1.0] * 3)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [0.0, 2.0])], "chunk_id long, v array<float>")
    index = proximity.build(rows)
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0])], "qid long, q array<float>")
    assert [(r.qid, r.chunk_id) for r in proximity.search(index, asked, 5).orderBy("rank").collect()] == [(1, 1), (1, 5)]
    assert proximity.search(proximity.build(rows.where("false")), asked, 5).count() == 0
    assert proximity.search(index, asked.where("false"), 5).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_registered(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.ef: r for r in registry.QUERIES["vector_graph_sweep"](spark, d).collect()}
    assert list(sorted(rows)) == [10, 20, 40, 100, 200, 400]
    assert rows[10].returned == 10 and rows[10].recall <= 0.5 and rows[20].returned == 20
    assert all(rows[e].recall >= 0.95 for e in (20, 40, 100, 200, 400)) and rows[20].visited_share < rows[100].visited_share
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    best = dense.exact_topk(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), 5)
    found = registry.QUERIES["vector_graph_topk"](spark, d)
    assert best.join(found, ["qid", "chunk_id"], "left_semi").count() >= 0.95 * best.count()


def test_one_walk_passes_the_ends_of_shorter_lists():
    v = proximity._unit(clustered(3000, 16).astype(np.float32))
    near, q, efs = proximity.neighbours(v), v[:60], (1, 5, 30, 90)
    together = proximity.walks(v, near, q, efs)
    for ef, (place, score, looked) in zip(efs, together, strict=True):
        own_place, own_score, own_looked = proximity.walk(v, near, q, ef)
        assert place.tolist() == own_place.tolist() and score.tolist() == own_score.tolist() and looked.tolist() == own_looked.tolist()
        assert np.allclose(score, np.einsum("nkd,nd->nk", v[place], q), atol=1e-6) and (np.diff(score, axis=1) <= 0).all()


def test_a_list_orders_scores_of_both_signs():
    score = np.array([0.5, -0.25, 0.0, -0.0, 1.0, -1.0], dtype=np.float32)
    keys = np.sort(proximity._keys(score, np.arange(6)))
    assert proximity._scores(keys).tolist() == [1.0, 0.5, 0.0, 0.0, -0.25, -1.0] and proximity._places(keys)[[0, 1, 4, 5]].tolist() == [4, 0, 1, 5]
    assert proximity._scores(np.array([proximity.EMPTY])).tolist() == [-np.inf] and proximity._places(np.array([proximity.EMPTY])).tolist() == [-1]


def plain_walk(v, near, q, ef):
    """One query with plain lists: what ``walks`` does for many."""
    start = np.unique(np.linspace(0, len(v) - 1, math.isqrt(len(v) - 1) + 1).astype(np.int64))
    score = lambda places: (-np.einsum("nd,nd->n", v[places], np.broadcast_to(q, (len(places), v.shape[1])))).tolist()
    seen, done = set(start.tolist()), set()
    held = sorted(zip(score(start), start.tolist(), strict=True))[:ef]
    while fresh := [x for x in held if x not in done]:
        done.add(fresh[0])
        to = np.array([p for p in near[fresh[0][1]].tolist() if p >= 0 and p not in seen], dtype=np.int64)
        seen |= set(to.tolist())
        held = sorted(held + list(zip(score(to), to.tolist(), strict=True)))[:ef]
    return [p for _, p in held], len(seen)


@pytest.mark.parametrize(("n", "efs"), [(2500, (1, 7, 60)), (40, (5, 90)), (1, (3,))])
def test_walks_of_many_are_those_of_each(n, efs):
    """blocks of candidates, an edge that rises and a list without order leave every step as it was; also where a list never fills."""
    x = np.random.default_rng(6).standard_normal((n, 10)).astype(np.float32)
    v = proximity._unit(x)
    near, q = proximity.neighbours(v), proximity._unit(np.random.default_rng(7).standard_normal((40, 10)).astype(np.float32))
    for ef, (place, _, looked) in zip(efs, proximity.walks(v, near, q, efs), strict=True):
        for i in range(len(q)):
            want, many = plain_walk(v, near, q[i], ef)
            assert place[i][: len(want)].tolist() == want and (place[i][len(want) :] == -1).all() and looked[i] == many


def test_steps_of_a_walk_do_not_sort_its_list():
    """a step with a long list costs about what one with a short list costs."""
    v = proximity._unit(np.random.default_rng(6).standard_normal((4000, 16)).astype(np.float32))
    near = proximity.neighbours(v)
    sorts = []
    plain = np.sort
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "sort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
        proximity.walks(v, near, v[:50], (300,))
    assert len(sorts) < 60  # over 300 steps
