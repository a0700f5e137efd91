"""The shingle join and the multi-index against brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, ngram_join
from tests.llm import messy


def plain(rows, width, num, den):
    sets, parent = defaultdict(list), {}
    for i, t, *_ in rows:
        w = messy.split(t)
        sets[i].append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            for p in sets[a]:
                for q in sets[b]:
                    both = len(p & q)
                    if p and q and den * both >= num * (len(p) + len(q) - both):
                        u, v = find(a), find(b)
                        parent[max(u, v)] = min(u, v)
    return Counter((i, len(s), find(i) if i is not None else None) for i, ss in sets.items() for s in ss)


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (1, 60)])
def test_near_duplicates(spark, width, num):
    rows = messy.rows(seed=width, n=150)
    got = ngram_join.near_duplicates(messy.documents(spark, seed=width, n=150), width, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, width, num, 100)


def test_chains_of_near_copies(spark):
    """A long chain: neighbours link and ends don't, so hubs alone cannot find it."""
    rng = random.Random(2)
    text, rows = messy.words(rng, 60), []
    for i in range(60):
        rows.append((i, " ".join(text), None, None, 0))
        text = list(text)
        text[rng.randrange(60)] = f"q{i}"
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, messy.SCHEMA), 4, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, 4, 85, 100)


def test_hot_group(spark):
    rng = random.Random(3)
    base = messy.words(rng, 80, 5000)
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(80)] = f"u{i}"
        rows.append((i, " ".join(t), None, None, 0))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, messy.SCHEMA), 4, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, 4, 85, 100)


@pytest.mark.parametrize("earlier", [1, 16])
def test_common_shingles(spark, monkeypatch, earlier):
    """Texts of few different words: many classes share each shingle, and few link."""
    monkeypatch.setattr(ngram_join, "EARLIER", earlier)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        t = [rng.choice("abcde") for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(t), None, None, 0))
        if i % 4 == 0:
            t[rng.randrange(len(t))] = "z"
            rows.append((1000 + i, " ".join(t), None, None, 0))
    for width, num in ((1, 60), (2, 70), (3, 80)):
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, messy.SCHEMA), width, num, 100).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, width, num, 100)


def test_a_pair_meets_once(spark):
    """However many shingles two classes share, one row of the join is theirs; a short window repeats it, never loses it."""
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(60), rng.randint(30, 40))) for _ in range(40)]

    def rows(window):
        out = []
        for i, s in enumerate(sets):
            prefix = s[: ngram_join.prefix_length(len(s), 60, 100)]
            out += [(t, i, (len(s) << 32) | k, i, prefix[max(0, k - window) : k]) for k, t in enumerate(prefix)]
        return [tuple(r) for r in ngram_join.meet(spark.createDataFrame(out, "tok long, rep int, np long, comp int, earlier array<long>"), 60, 100).select("a", "b").collect()]

    once, some, every = rows(60), rows(2), rows(0)
    assert len(set(once)) == len(once) and set(once) == set(some) == set(every) and len(every) > 4 * len(once)
    linked = {(a, b) for b in range(40) for a in range(b) if 10 * len(set(sets[a]) & set(sets[b])) >= 6 * len(set(sets[a]) | set(sets[b]))}
    assert linked and linked <= set(once)


def test_prefix_lengths():
    for n in range(1, 200):
        p = ngram_join.prefix_length(n, 85, 100)
        # a partner of any size at the threshold shares at least ceil(0.85 n) tokens
        assert n - p < -(-85 * n // 100) and p >= 1


def test_deduplicated_rows(spark):
    docs = messy.documents(spark, n=100)
    stay = ngram_join.deduplicate(docs)
    want = {c for (_, _, c) in plain(messy.rows(n=100), 5, 80, 100) if c is not None}
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect() if r.doc_id is not None} == want


def test_no_documents(spark):
    assert ngram_join.near_duplicates(messy.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], messy.SCHEMA)
    assert sorted(map(tuple, ngram_join.near_duplicates(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


# ---- neighbours


def vectors(spark, n=400, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[50:110] = x[50]  # a common vector
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * dim), (5040, [float("nan")] + [1.0] * (dim - 1)), (5060, [float("inf")] * dim), (5080, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim), (5100, []), (5120, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd + [rows[7], rows[20]], "vec_id long, embedding array<float>")
    return messy.clash(df), x.astype(np.float64)


def brute(x, q, k):
    s = np.add.reduce(x * x[q], axis=1)
    order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]
    return [(i, s[i]) for i in order]


def test_exhaustive_search_is_exact(spark):
    df, x = vectors(spark)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        want = brute(x, q, 20)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & {i for i, _ in brute(x.astype(np.float64), q, 20)}) for q in range(0, 3000, 20)]
    assert np.mean(hits) / 20 >= 0.9


def test_cells_come_in_order():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal(9), rng.standard_normal(7)
    counts = np.ones(63, dtype=int).tolist()
    order = ann.nearest_cells(a, b, counts, 63)
    sums = [a[c // 7] + b[c % 7] for c in order]
    assert sorted(order) == list(range(63)) and sums == sorted(sums)
    assert ann.nearest_cells(a, b, counts, 10) == order[:10]


@pytest.mark.parametrize("group", [50, 700, 8000])
def test_groups_of_the_index(spark, monkeypatch, group):
    """Groups that split a centroid, groups that hold many, and lots of queries find the same."""
    monkeypatch.setattr(ann, "LEAST_GROUP", group)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 6)
    monkeypatch.setattr(ann, "LEAST_CENTROIDS", 5)
    df, x = vectors(spark)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert {q: [i for i, _ in brute(x, q, 20)] for q in range(0, 400, 20)} == got


def test_only_visited_cells_are_multiplied():
    rng = np.random.default_rng(6)
    v, q = rng.standard_normal((200, 5)), rng.standard_normal((30, 5))
    edge = np.concatenate(([0], np.sort(rng.integers(0, 201, 15)), [200]))
    visits = rng.random((30, 16)) < 0.3
    s, made = ann.visited_products(q, v, edge, visits)
    inside = np.repeat(visits, np.diff(edge), axis=1)
    assert made == inside.sum() and (np.isfinite(s) == inside).all()
    assert np.allclose(s[inside], (q @ v.T)[inside])


def test_the_budget_grows_slower_than_the_vectors():
    sizes = [500, 5_000, 50_000, 5_000_000]
    shares = [ann.budget(n, ann.SHARE, 21) / n for n in sizes]
    assert shares[0] == 0.5 and all(b < 0.9 * a for a, b in zip(shares, shares[1:], strict=False))
    assert ann.budget(1000, 1.0, 21) == 1000 and ann.budget(10, 0.5, 21) == 21


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_registered_query(spark, sf):
    from lodestar.llm import queries

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    e = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ids = np.array(sorted(e))
    m = np.array([e[i] for i in ids])
    got = defaultdict(set)
    for r in queries.op10_ann(spark, d).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & {int(ids[i]) for i, _ in brute(m, int(np.searchsorted(ids, q)), 20)}) for q in ids[ids % 20 == 0].tolist()]
    assert np.mean(hits) / 20 >= 0.9


def test_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]
