"""Exact dedup, sharding and mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestar.llm import exact_dedup, mixing, sharding
from tests.llm import messy


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = messy.rows()
    got = exact_dedup.classify(messy.documents(spark), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[messy.fold(t)].append(i)
    pick = min if keep == "smallest" else max
    expected = Counter()
    for t, ids in groups.items():
        some = [i for i in ids if i is not None]
        k = pick(some) if some else None
        for i in ids:
            expected[(i, k, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_deduplicate_keeps_whole_rows(spark):
    docs = messy.documents(spark)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    texts = [messy.fold(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({messy.fold(t) for _, t, *_ in messy.rows()})


def test_hash_collisions_do_not_merge(spark, monkeypatch):
    """Bytes decide: with both hashes constant every text is still a class of its own."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: F.lit("same"))
    rows = messy.rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[messy.fold(t)].append(i)
    got = exact_dedup.classify(messy.documents(spark)).collect()
    want = Counter((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want and sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(messy.documents(spark)).collect()
    assert sorted(messy.fold(r.text) for r in kept) == sorted(groups)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_deduplicate_keeps_the_named_row(spark, keep):
    pick, of = {"smallest": min, "largest": max}[keep], defaultdict(list)
    for i, t, *_ in messy.rows(n=120):
        of[messy.fold(t)].append(i)
    want = Counter(pick([i for i in ids if i is not None], default=None) for ids in of.values())
    assert Counter(r.doc_id for r in exact_dedup.deduplicate(messy.documents(spark, n=120), keep=keep).collect()) == want


def test_shards(spark):
    rows = messy.rows(n=400)
    got = sharding.shard_by_bytes(messy.documents(spark, n=400), 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[(r["size"], r.text_crc32)].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the long text aside, no group is a tenth of a shard
    assert sum(len(s) > 1 for s in of_text.values()) <= 2


def test_shards_are_balanced(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + "y" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    total = [r["b"] for r in sharding.shard_by_bytes(docs, 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(total) == 8 and max(total) < 1.02 * sum(total) / 8


def test_shards_of_a_hot_group(spark):
    """A group larger than a shard is cut, so that sizes stay near equal; the others stay whole."""
    rows = [(i, "the same text") for i in range(3000)] + [(None, "the same text")] * 5 + [(10_000 + i, f"text {i // 2}") for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
    assert len(size) == 8 and max(size.values()) < 1.02 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for c, s in of_text.items() if c != zlib.crc32(b"the same text"))


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return held | share
        held |= {s: cap * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 100, "b": 900, "c": 5, "d": 40, None: 7}, {"x": 10}, {"a": 1, "b": 1000, "é": 3}, {"a": 0, "b": 10}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got == pytest.approx(want), sizes


def test_mix(spark):
    rows = messy.rows(n=500)
    n = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    docs = messy.documents(spark, n=500)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, n(t)) for i, t, *_ in rows)
    sizes, largest = Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += n(t)
        largest[s] = max(largest[s], n(t))
    want, taken = plain_targets(dict(sizes)), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.times * r["size"] and r.times <= 3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
        times = {r.times for r in got if r.source == s}
        assert max(times) - min(times) <= 1  # complete epochs before a fraction
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_takes_the_rows_of_a_plain_sampler(spark):
    """Exponential keys in order, the middle of a row within the budget; with qualities far apart."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))), rng.choice("aab") if i % 50 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = F.when(F.col("doc_id") % 3 == 0, 0.001).when(F.col("doc_id") % 3 == 1, 1.0).otherwise(40.0)
    got = {r.doc_id: r for r in mixing.mix(docs, quality=quality).collect()}
    draws = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(20)).alias("h")).collect()}
    key = lambda i: -math.log(((draws[i] % 2**64 >> 11) + 0.5) / 2**53) / (0.001, 1.0, 40.0)[i % 3]
    seen = set()
    for s in ("a", "b", None):
        ids = sorted((i for i, _, x in rows if x == s), key=key)
        whole, target = got[ids[0]].source_size, got[ids[0]].target
        run, left = 0, target - target // whole * whole
        for i in ids:
            extra = run + got[i]["size"] / 2 <= left and run < left
            run += got[i]["size"]
            seen.add(bool(extra))
            assert got[i].times == target // whole + extra
    assert seen == {True, False}


def test_mix_parts_are_small(spark):
    """No part of the key holds much of a source, whatever its qualities, and null ids are spread by their text."""
    from pyspark.sql import functions as F

    docs = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), "id")
    seen = []
    real = mixing.cut
    mixing.cut = lambda df, tag: seen.append((tag, real(df, tag))) or seen[-1][1]
    try:
        mixing.mix(docs, quality=F.when(F.col("id") % 3 == 0, 0.01).otherwise(5.0)).count()
    finally:
        mixing.cut = real
    keys = dict(seen)["keys"]
    assert keys.groupBy("fine").count().agg(F.max("count")).first()[0] < 40  # 6.2 expected at most
    assert keys.groupBy("coarse").count().agg(F.max("count")).first()[0] < 200_000 / 16


def test_mix_prefers_quality(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "one two three", "a" if i % 2 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 3), quality=F.when(F.col("doc_id") % 4 == 1, 10.0).otherwise(1.0)).where("source = 'a'").collect()
    good = sum(r.times for r in got if r.doc_id % 4 == 1)
    assert good > 0.75 * sum(r.times for r in got)


def test_text_quality(spark):
    from pyspark.sql import functions as F

    texts = [None, "", "a clean sentence about houses near rivers", "a b c d e f g h", "#### $$$$ %%%% &&&&", "x" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    q = {r.i: r.q for r in df.select("i", mixing.text_quality(F.col("text"), mixing.n_words(F.col("text"))).alias("q")).collect()}
    assert q[0] == q[1] == pytest.approx(0.1) and all(0.1 <= x <= 1 for x in q.values())
    assert q[2] > 0.9 and q[3] < q[2] and q[4] == pytest.approx(0.1) and q[5] == pytest.approx(0.1)


def test_applied_mix(spark):
    docs = messy.documents(spark, n=200)
    got = mixing.apply(docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        if r.taken:
            want[r.doc_id] = max(want[r.doc_id], r.times)
    repeats = Counter(i for i, t, *_ in messy.rows(n=200))
    seen = Counter(r.doc_id for r in got.collect())
    assert all(seen[i] == want[i] * repeats[i] for i in want if i is not None)


def test_empty(spark):
    docs = messy.empty(spark)
    assert exact_dedup.classify(docs).count() == 0 and exact_dedup.deduplicate(docs).count() == 0
    assert sharding.shard_by_bytes(docs).count() == 0 and mixing.mix(docs).count() == 0 and mixing.apply(docs).count() == 0
