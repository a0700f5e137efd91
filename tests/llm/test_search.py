"""Divergence audit, ranked search and SimHash against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import divergence, search, simhash, textkernels
from tests.llm import messy

LETTERS, ALNUM = "[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


@pytest.fixture
def short_pieces(monkeypatch):
    """Texts of over 200 bytes come in pieces (in this process; workers take it from the kernel's default)."""
    monkeypatch.setattr(textkernels.pieces, "__defaults__", (200,))


def utf8(text):
    return text.encode()


# --- pieces and numbers


@pytest.mark.parametrize("sep", [textkernels.SPACES, textkernels.NOT_LETTERS, textkernels.NOT_ALNUM])
def test_pieces_cut_no_word(sep):
    rng = random.Random(4)
    texts = [None, "", "x" * 900, " ".join(messy.words(rng, 400)), "é" * 300 + " b", " " * 700, "a"]
    got = defaultdict(list)
    for at, data, offsets, _ in textkernels.pieces(pa.array(texts), sep, 64):
        words = textkernels.Words(data, offsets, sep=sep)
        for r, w in zip(words.row, words.strings().to_pylist(), strict=True):
            got[at + r].append(w)
    wanted = {textkernels.SPACES.tobytes(): "[^\x20\x09-\x0d]+", textkernels.NOT_LETTERS.tobytes(): LETTERS, textkernels.NOT_ALNUM.tobytes(): ALNUM}[sep.tobytes()]
    for i, t in enumerate(texts):
        assert got[i] == re.findall(wanted, messy.fold(t))


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    values = np.concatenate(([0, 1, 127, 128, 16383, 16384, (1 << 62) + 5], rng.integers(0, 1 << 40, 500), rng.integers(0, 300, 500)))
    data, ends = search.pack(values)
    assert ends[-1] == len(data) and (search.unpack(data) == values).all()
    assert (search.unpack(data[ends[9] : ends[20]]) == values[10:21]).all()
    assert len(search.unpack(search.pack(np.zeros(0, dtype=np.int64))[0])) == 0


def test_xxh64_of_all_lengths():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4800, 400)
    end = start + np.concatenate((np.arange(150), rng.integers(0, 200, 250)))
    for seed in (42, 0):
        assert simhash.xxh64(data, start, end, seed).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(start, end, strict=True)]


def test_exact_shares():
    rng = random.Random(8)
    total = np.array([rng.randint(10, 8_000_000_000_000_000) for _ in range(200)])
    count = np.array([rng.randint(0, int(t) - 2) for t in total])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total, strict=True)]


# --- op11


def plain_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(LETTERS, messy.fold(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)

        def share(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        n = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in own}
        q = {t: share(sum(counts[lang, s][t] for s in own), sum(n.values())) for t in kept}

        def far(x, y):
            return (x - y) ** 2 // (x + y)

        for s in own:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), utf8(o)) for o in own if o != s)
            terms = sorted((-far(p[s][t], q[t]), utf8(t)) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "cells", "counts"), [(2, 1 << 20, 1 << 20), (1, 40, 50), (10, 1 << 20, 1 << 20), (1000, 1 << 20, 1 << 20)])
def test_audit(spark, monkeypatch, least, cells, counts):
    monkeypatch.setattr(divergence, "TILE_CELLS", cells)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "MOST_COUNTS", counts)
    rows = messy.rows(seed=5, n=80) + [(7000 + k, t, lang, "", 0) for k, (t, lang) in enumerate([("Éa ß ss 中文 É", "xx"), ("a_b 1c2 éa", ""), (None, "yy"), ("zz zz", None)])]
    docs = messy.clash(spark.createDataFrame(rows, messy.SCHEMA)).repartition(3)
    got = divergence.audit(docs, least_docs=least, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, 4)


def test_counts_of_long_texts_in_pieces(short_pieces):
    rng = random.Random(2)
    texts = [" ".join(messy.words(rng, 300)), "a b a", None, "-".join(messy.words(rng, 200)) + " a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", None, "en"]), pa.array(["s", "s", "t", None]), pa.array(texts)], ["lang", "source", "text"])
    got = Counter()
    for out in divergence._count(iter([batch, batch])):
        for r in out.to_pylist():
            got[r["source"], r["term"]] += r["n"] + 1000 * r["docs"]
    wanted = Counter()
    for t, s in zip(texts, ["s", "s", "t", ""], strict=True):
        found = Counter(re.findall(LETTERS, messy.fold(t)))
        for w, n in found.items():
            wanted[s, w] += 2 * n + 2000
    assert got == wanted


def test_many_sources_of_one_language(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(messy.words(rng, 12, 40)), "en", f"s{i % 150}", 0) for i in range(450)]
    got = divergence.audit(spark.createDataFrame(rows, messy.SCHEMA), least_docs=3, top=3)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 3)


# --- op12


def plain_search(rows, items, k):
    docs = [(r[0], Counter(re.findall(ALNUM, messy.fold(r[1])))) for r in rows if r[0] is not None]
    docs = [d for d in docs if d[1]]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, text in items:
        if i is not None:
            asked[i] |= set(re.findall(ALNUM, messy.fold(text)))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("docs_a_shard", "window", "lot"), [(1 << 15, 1 << 13, 4096), (7, 3, 2)])
def test_ranked(spark, monkeypatch, docs_a_shard, window, lot):
    monkeypatch.setattr(search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(search, "LOT_ITEMS", lot)
    monkeypatch.setattr(search.merge_lists, "__defaults__", (window,))
    rows = messy.rows(seed=6, n=90) + [(8000 + k, "tie tie x1", None, None, 0) for k in range(15)]
    items = [(1, rows[0][1]), (2, "TIE é 中文"), (3, None), (4, ""), (None, "tie"), (5, "no such words"), (6, "x1 x1 y2"), (6, rows[9][1]), (7, rows[-20][1]), (-3, "Éa b c a")]
    got = search.ranked(messy.clash(spark.createDataFrame(rows, messy.SCHEMA)).repartition(3), messy.clash(spark.createDataFrame(items, "item_id long, text string")), k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search(rows, items, 10)


def test_index_of_long_texts_in_pieces(short_pieces, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 3)
    rng = random.Random(3)
    ids, texts = [9, 4, -2, 7, 5], [" ".join(messy.words(rng, 300)), "a b1 a", None, "-".join(messy.words(rng, 200)) + " a", "!"]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(texts[a:b])], ["id", "text"]) for a, b in ((0, 3), (3, 5))]
    got, known = {}, {}
    for out in search._index(iter(batches)):
        for r in out.to_pylist():
            if r["term"] is None:
                known[r["shard"]] = np.frombuffer(r["docs"], dtype=np.int64).tolist()
                assert known[r["shard"]] == sorted(known[r["shard"]])
                continue
            docs, counts = (search.unpack(np.frombuffer(r[c], dtype=np.uint8)) for c in ("docs", "counts"))
            assert r["n"] == len(docs) and r["terms"] == counts.sum()
            for d, c in zip(np.cumsum(docs).tolist(), counts.tolist(), strict=True):
                got[known[r["shard"]][d], r["term"]] = c
    assert got == {(i, w): n for i, t in zip(ids, texts, strict=True) for w, n in Counter(re.findall(ALNUM, messy.fold(t))).items()}
    assert len(known) == 2


def test_merge_of_random_lists():
    rng = np.random.default_rng(5)
    for _ in range(50):
        held, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        lists = []
        for _ in range(int(rng.integers(0, 7))):
            docs = np.flatnonzero(rng.random(held) < rng.random())
            lists.append((docs, rng.integers(0, 4, len(docs))))
        score = np.zeros(held, dtype=np.int64)
        for docs, gains in lists:
            score[docs] += gains
        wanted = sorted(((int(s), -d) for d, s in enumerate(score) if s > 0), reverse=True)[:k]
        assert search.merge_lists(lists, held, k, window=int(rng.integers(1, 20))) == wanted


# --- op13


def plain_fingerprint(text, width):
    w = messy.split(text)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("width", [3, 5])
def test_near_duplicates(spark, width):
    rows = messy.rows(seed=8, n=110)
    rng = random.Random(1)
    base = messy.words(rng, 400)
    for k in range(25):
        t = list(base)
        t[rng.randrange(len(t))] = f"other{k % 3}"
        rows.append((9000 + k, " \t".join(t), "en", "s1", 0))
    got = simhash.near_duplicates(messy.clash(spark.createDataFrame(rows, messy.SCHEMA)).repartition(3), width=width).collect()
    fp = {}
    for i, t, *_ in rows:
        if i is not None:
            fp[i, t] = plain_fingerprint(t, width)
    nodes = sorted(set(fp.values()))
    comp = plain_components(nodes, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), f in fp.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    text_of = Counter((i, f"{plain_fingerprint(t, width):016x}", None if i is None else least[comp[plain_fingerprint(t, width)]]) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == text_of
    assert any(n > 2 for n in Counter(r.component_id for r in got if r.component_id is not None).values())


def test_fingerprints_of_long_texts_in_pieces(short_pieces):
    rng = random.Random(7)
    texts = [None, " ".join(messy.words(rng, 500)), "a b", "x" * 500, "x" * 500 + "\n b", " " * 450, "\tA  B\n\nc d ", "é " * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    for width in (1, 2, 3, 5):
        got = next(simhash._fingerprints(width)(iter([batch]))).column(1).to_pylist()
        assert [x % 2**64 for x in got] == [plain_fingerprint(t, width) for t in texts]


def test_anchors_cover(spark):
    rng = random.Random(11)
    words = [rng.getrandbits(64) for _ in range(40)]
    words += [w ^ (1 << rng.randrange(64)) for w in words] + [0, 2**64 - 1]
    signed = [w - 2**64 if w >= 2**63 else w for w in words]
    for half in (0, 1):
        got = {r.fp: r.at for r in spark.createDataFrame([(w,) for w in signed], "fp long").select("fp", simhash.anchors(F.col("fp"), half).alias("at")).collect()}
        own = {w: (w >> 32 * half) & (2**31 - 1) for w in signed}
        for w, at in got.items():
            away = [bin(own[w] ^ a).count("1") for a in at]
            assert away[0] <= 1 and all(d == 2 for d in away[1:]) and len(set(at)) == len(at) == (1 if away[0] == 0 else 16)
        for w, v in zip(signed, signed[40:80], strict=False):
            assert got[w][0] in got[v] and got[v][0] in got[w]


def test_links_join_what_is_near_without_all_pairs(spark, monkeypatch):
    """A crowded anchor is split; its links have the components of all pairs and are few."""
    monkeypatch.setattr(simhash, "MOST_HOME", 7)
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    rows = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: rows)
    seen = []
    settle = simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: seen.append(links.count()) or settle(links))
    got = {int(r.fingerprint, 16): r.component_id for r in simhash.near_duplicates(rows.withColumn("text", F.lit("")), id_col="id").collect()}
    comp = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert got == {f: fps.index(comp[f]) for f in fps}
    assert seen[0] < 2 * 32 * len(fps)


def test_kernel_over_small_batches():
    """Anchors that go on from one batch to the next."""
    rng = np.random.default_rng(13)
    keys = np.sort(rng.integers(0, 12, 200))
    centre = rng.integers(0, 1 << 62, 12)
    fps = np.array([int(centre[k]) ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for k in keys])
    away = rng.random(200) < 0.7
    order = np.lexsort((away, keys))
    k, fps = (keys * 2 + away)[order], fps[order]
    for size in (1, 3, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(k[a : a + size]), pa.array(fps[a : a + size])], ["k", "fp"]) for a in range(0, 200, size)]
        links = {(r["a"], r["b"]) for b in simhash._compare(3)(iter(batches)) for r in b.to_pylist()}
        nodes = sorted(set(fps.tolist()))
        homes = {(int(x) >> 1, f) for x, f in zip(k, fps.tolist(), strict=True) if not x & 1}
        all_at = {(int(x) >> 1, f) for x, f in zip(k, fps.tolist(), strict=True)}
        near = {(f, g) for a, f in all_at for b, g in homes if a == b and f != g and bin(f ^ g).count("1") <= 3}
        assert links <= near
        assert plain_components(nodes, lambda a, b: (a, b) in links or (b, a) in links) == plain_components(nodes, lambda a, b: (a, b) in near or (b, a) in near)


@pytest.mark.parametrize("run", [divergence.audit, simhash.near_duplicates, lambda d: search.ranked(d, d.select(F.col("doc_id").alias("item_id"), "text"))])
def test_empty(spark, run):
    assert run(messy.empty(spark)).count() == 0


def test_wrong_distance(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(messy.empty(spark), distance=4)
