"""Kernels, packing, archives, classifiers and the language model."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import langid, lm, packing, quality, seating, warc
from lodestar.llm import textkernels as tk
from tests.llm import messy


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


# ---- kernels


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_words_and_windows(limit):
    rng = random.Random(1)
    texts = [None, "", "  ", "A b\tc", "é ß x　y", *messy.thue_morse(), " ".join(messy.thue_morse(64)), "x" * 63, "x" * 64, "x" * 65, *["".join(rng.choice("aB é\n\t.") for _ in range(rng.randint(0, 40))) for _ in range(300)]]
    seen, grams = {}, {}
    for at, data, offsets in tk.chunks(pa.array(texts), limit):
        w = tk.Words(data, offsets)
        h = w.hashes()
        got = [[bytes(w.low[s:e]).decode() for s, e, r in zip(w.start, w.end, w.row, strict=True) if r == i] for i in range(w.rows)]
        assert got == [messy.split(t) for t in texts[at : at + w.rows]]
        for word, x in zip([x for g in got for x in g], h.tolist(), strict=True):
            assert seen.setdefault(word, x) == x
        row, shingle = tk.windows(h, w.row, w.rows, 3)
        for i, g in enumerate(got):
            want = [tuple(g[k : k + 3]) for k in range(max(1, len(g) - 2))] if g else []
            assert len(want) == (row == i).sum()
            for x, y in zip(want, shingle[row == i].tolist(), strict=True):
                assert grams.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_ranges_are_compared_by_their_bytes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 200]))) for _ in range(300)]
    texts += ["a" * 200, "a" * 199 + "b"]
    (_, data, offsets), = tk.chunks(pa.array(texts))
    start, end = offsets[:-1], offsets[1:]
    mates = [rng.choice([i, rng.randrange(len(texts))]) for i in range(len(texts) - 2)] + [len(texts) - 1, len(texts) - 1]
    got = tk.same_ranges(data, start, end, data, start[mates], end[mates])
    assert got.tolist() == [texts[i] == texts[j] for i, j in enumerate(mates)]
    h, g = tk.range_hashes(data, start, end), tk.range_hashes(data, start, end, 1)
    assert len(set(h.tolist())) == len(set(g.tolist())) == len(set(texts)) and not set(h.tolist()) & set(g.tolist())


# ---- packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_of_odd_texts():
    rng = random.Random(3)
    alphabet = "abZÉéß×÷ 's 123.,!<|endoftext|>\t\n  –“’Ωσς가́x\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["it's they'll", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "É É", "x́ é", "Å", "中文 字", "ÀÈÌ×÷ÿÞ Ÿ ß", "", None, "don't42!?", "a1b2", "12345"]
    t = tokenizer()
    coder = packing.WordIds(t.to_str())
    for at, data, offsets in tk.chunks(pa.array(texts), 3000):
        ids, counts = coder.encode(data, offsets)
        to = 0
        for k, n in enumerate(counts.tolist()):
            assert ids[to : to + n].tolist() == t.encode(texts[at + k] or "", add_special_tokens=False).ids, texts[at + k]
            to += n


def test_equal_hashes_of_different_words(monkeypatch):
    monkeypatch.setattr(packing.Words, "hashes", lambda self, data=None, lane=0: np.zeros(len(self), dtype=np.uint64))
    t = tokenizer()
    coder = packing.WordIds(t.to_str())
    texts = ["one two", "three", "one a1", "<|x"]
    (_, data, offsets), = tk.chunks(pa.array(texts))
    for _ in range(2):
        ids, counts = coder.encode(data, offsets)
        assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids] and counts.sum() == len(ids)


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        capacity = rng.randint(1, 60)
        sums = {0}
        for n, c in left.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        best, taken = packing.fullest(capacity, sorted(left, reverse=True), dict(left))
        assert best == max(s for s in sums if s <= capacity) == sum(n * c for n, c in taken.items())
        assert all(c <= left[n] for n, c in taken.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    counts = Counter(rng.choice([rng.randint(1, 64), 7, 64]) for _ in range(500))
    used, sequences = Counter(), 0
    for first, times, items in packing.plan(dict(counts), 64):
        assert first == sequences and sum(n * c for n, c in items) <= 64
        sequences += times
        for n, c in items:
            used[n] += c * times
    assert used == counts
    assert sequences <= sum(n * c for n, c in counts.items()) / 64 + 2


def test_pack_round_trip(spark):
    got = packing.pack(messy.documents(spark), window=256).collect()
    t = tokenizer()
    want, pieces = Counter(), defaultdict(list)
    for i, text, *_ in messy.rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 256):
            want[(i, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    for r in got:
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 256
    assert sorted(pieces) == list(range(len(pieces)))
    assert packing.pack(messy.empty(spark)).count() == 0


# ---- archives


def pages(spark):
    rng = random.Random(6)
    bodies = [f"<p>{'é' * rng.randint(0, 5)} {k}</p>" for k in range(30)]
    rows = [(k, f"http://x/{k}\r\n", rng.choice(bodies)) for k in range(200)]
    rows += [(500, None, None), (501, "http://y", ""), (502, "http://z", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (503, "http://l", "long " * 200_000), (None, "http://n", "no id")]
    return messy.clash(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3), rows


@pytest.mark.parametrize("least", [0, 12])
def test_archives(spark, least):
    df, rows = pages(spark)
    got, path = warc.deduplicate(df, least)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((h or "").encode()) >= least:
            first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h or "", i) if i is not None else i
        revisit = i is not None and to != i
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", to if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    back = {(r.record, r.payload) for r in warc.read_archives(spark, path, True).where("type = 'response'").collect()}
    assert ("<urn:page:502>", rows[202][2]) in back and ("<urn:page:503>", rows[203][2]) in back


def test_archives_are_bounded_by_bytes_and_stay(spark, tmp_path, monkeypatch):
    """Large payloads lie in files of few records, and archives at a given path outlive the session's tables."""
    import glob
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    rng = random.Random(9)
    rows = [(i, f"http://x/{i}" if i % 9 else None, "é" * rng.choice([0, 10, 400, 1500, 9000, 40_000])) for i in range(120)]
    out = str(tmp_path / "archives")
    got, path = warc.deduplicate(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path=out)
    assert path == out and {r.page_id: r.target_uri for r in got.collect()} == {i: u for i, u, _ in rows}
    sizes = [[len(b) for _, b in warc.parse(gzip.open(f))] for f in glob.glob(f"{out}/*/*.gz")]
    assert sum(map(len, sizes)) == len(rows)
    assert all(sum(s) <= 20_000 + 20 * len(warc.HTTP_HEAD) or len(s) == 1 for s in sizes)
    from lodestar.llm import runtime

    assert out not in runtime._made


def test_urls_keep_their_white_space(spark):
    urls = {1: " http://x/1", 2: "http://x/2 \t", 3: "http://x/a b", 4: None}
    got, _ = warc.deduplicate(spark.createDataFrame([(i, u, f"body {i}") for i, u in urls.items()], "page_id long, url string, html string"))
    assert {r.page_id: r.target_uri for r in got.collect()} == urls


def test_no_pages(spark):
    got, _ = warc.deduplicate(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0


def test_a_damaged_record_is_seen(spark, tmp_path):
    import gzip

    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: x\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(head))
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(spark, str(tmp_path)).collect()


# ---- classifiers


LANGS = {"en": ["the", "and", "with", "this", "house", "water", "think"], "de": ["der", "und", "mit", "dieses", "haus", "wasser", "schön"], "fr": ["le", "et", "avec", "cette", "maison", "eau", "être"]}


def speech(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "en" if lang == "de" else "s"]) for _ in range(n))


def test_language(spark):
    rng = random.Random(7)
    truth = {i: rng.choice(list(LANGS)) for i in range(400)}
    rows = [(i, speech(rng, l, rng.randint(5, 60)), l) for i, l in truth.items()]
    mixed = [(1000 + i, speech(rng, "en", 60) + " " + speech(rng, "de", 30), None) for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "12 !", "fr"), (2003, "12 é !", None), (None, "the house and", "en"), (2004, speech(rng, "fr", 30_000), None)]
    df = messy.clash(spark.createDataFrame(rows + mixed + odd + [rows[3]] * 2, "doc_id long, text string, lang string"))
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(mixed) + len(odd) + 2
    by = {r.doc_id: r for r in got}
    held = [i for i in truth if crc(i, 5) == 0]
    assert all(by[i].held_out for i in held) and not any(r.held_out for r in got if crc(r.doc_id, 5))
    assert np.mean([by[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for i, *_ in mixed:
        assert by[i].lang_pred == "en" and by[i].n_languages == 2 and abs(by[i].score - 2 / 3) < 0.1
    for i in (2000, 2001, 2002):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[2003].lang_pred != "und" and by[2004].lang_pred == "fr"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(by) - {2000, 2001, 2002}


def plain_mixture(loglik, allowed, rounds):
    """EM of one document, word by word."""
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(rounds):
        total = dict.fromkeys(allowed, 0.0)
        for word in loglik:
            joint = {k: share[k] * math.exp(word[k]) for k in allowed}
            for k in allowed:
                total[k] += joint[k] / sum(joint.values())
        share = {k: v / len(loglik) for k, v in total.items()}
    return share, sum(math.log(sum(share[k] * math.exp(word[k]) for k in allowed)) for word in loglik)


def test_mixtures_and_sets_against_plain_ones():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 7, 30, 80]
    loglik = np.concatenate([rng.normal(-6, 2, (n, 4)) + 3 * np.eye(4)[rng.integers(0, 1 + k % 4, n)] for k, n in enumerate(sizes)])
    starts = np.cumsum([0, *sizes[:-1]])
    best, chosen = langid.choose(loglik, starts)
    for d, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        words = loglik[s : s + n].tolist()
        full, _ = plain_mixture(words, range(4), langid.ROUNDS)
        order = sorted(range(4), key=lambda k: -full[k])
        value, kept = -math.inf, None
        for k in range(1, 5):
            share, ll = plain_mixture(words, order[:k], langid.ROUNDS)
            now = ll - langid.PENALTY * k * 0.5 * math.log(n + 1)
            if now <= value:
                break
            value, kept = now, share
        assert chosen[d] == len(kept)
        assert best[d].tolist() == pytest.approx([kept.get(k, 0.0) for k in range(4)], abs=1e-9)


def test_clean_documents_of_many_languages_stay(spark):
    rng = random.Random(14)
    rows = [(i, speech(rng, l, 30), l) for i, l in enumerate([*LANGS] * 30)]
    rows += [(500, " ".join(speech(rng, l, 20) for l in LANGS), None), (501, "12 !", None)]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in rows} - {501}
    blank = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(blank).count() == 2  # nothing was learned, so nothing is rejected


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(messy.empty(spark)).count() == 0


def test_likelihoods_of_words_in_blocks(monkeypatch):
    """Words by lots of bytes, equal words once, a word beyond a lot: the same as byte by byte."""
    rng = np.random.default_rng(3)
    table = rng.normal(-5, 1, (langid.CELLS, 3)).astype(np.float32)
    texts = pa.array(["ab abc ab", "", "x" * 500 + " Abc", "c"])
    (_, data, offsets), = langid.chunks(texts)
    words = langid.Words(data, offsets)
    pick = np.arange(len(words))
    whole = langid.likelihoods(words, pick, table)
    for block in (1, 7, 100):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert langid.likelihoods(words, pick, table) == pytest.approx(whole)
    for k, w in enumerate("ab abc ab".split() + ["x" * 500, "abc", "c"]):
        cells = langid.trigram_cells(np.frombuffer(w.encode(), np.uint8), np.array([0]))
        assert whole[k] == pytest.approx(table[cells].sum(axis=0, dtype=np.float64))
    times = np.array([2.0, 1.0])
    twice, ll = langid.proportions(whole[[0, 1, 0]], np.array([0]), np.ones((1, 3)))
    once, same = langid.proportions(whole[[0, 1]], np.array([0]), np.ones((1, 3)), times)
    assert once == pytest.approx(twice) and same == pytest.approx(ll)


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(docs)


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        t = messy.words(rng, rng.randint(20, 60))
        if not good:
            t = [w + rng.choice(["%%%", "&&&", "!!"]) if rng.random() < 0.6 else w.upper() for w in t]
        rows.append((i, " ".join(t)))
        labels.append((i, int(good)))
    odd = [(9000, None), (9001, ""), (9002, "x" * 100_000), (None, "words here"), rows[3]]
    docs = messy.clash(spark.createDataFrame(rows + odd, "doc_id long, text string"))
    marks = spark.createDataFrame(labels + [(5, 1), (None, 1), (7, None), (77777, 0)], "doc_id long, quality int")
    got = quality.score(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    blank = {r.doc_id: r.score for r in got if r.doc_id in (9000, 9001)}
    assert blank[9000] == blank[9001]


def test_quality_fits_an_id_once(spark):
    """An id that repeats is one row of the fit, whatever its texts and their order."""
    rows = [(i, f"good words of row {i}" if i % 2 else f"BAD %%% row {i}") for i in range(60)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    copies = spark.createDataFrame(rows + [rows[3]] * 500 + [rows[6]] * 300, "doc_id long, text string").repartition(5)
    assert once.tolist() == quality.train(copies, marks).tolist()


def test_updates_against_plain_ones():
    """FTRL-proximal as it is written down, one weight at a time."""
    rng = np.random.default_rng(4)
    size = 30
    rows = [(np.unique(rng.integers(0, size, 6)), int(rng.integers(0, 2))) for _ in range(60)]
    rows = [(at, rng.random(len(at)), y) for at, y in rows]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    quality.fit_ftrl(rows, z, n)
    pz, pn = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1, l2 = (quality.L1, quality.L2) if i < size else (0.0, 0.0)
        if abs(pz[i]) <= l1:
            return 0.0
        return -(pz[i] - math.copysign(l1, pz[i])) / ((quality.BETA + math.sqrt(pn[i])) / quality.ALPHA + l2)

    for at, x, y in rows:
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            sigma = (math.sqrt(pn[i] + g * g) - math.sqrt(pn[i])) / quality.ALPHA
            pz[i] += g - sigma * w[i]
            pn[i] += g * g
    assert z.tolist() == pytest.approx(pz) and n.tolist() == pytest.approx(pn)
    assert quality.weights_of(z, n).tolist() == pytest.approx([weight(i) for i in range(size + 1)], abs=1e-6)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5, 0.5]
    assert quality.score(messy.empty(spark), none).count() == 0


# ---- language model


def corpus(seed=9, n=400):
    rng = random.Random(seed)
    parts = ["an", "ber", "co", "de", "er", "fi", "go", "hal", "in", "ju"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    rows = []
    for i in range(n):
        k, text = 0, []
        for _ in range(rng.randint(1, 120)):
            # half of the words follow from the one before
            k = (7 * k + rng.randint(0, 2)) % 3000 if rng.random() < 0.5 else int(3000 * rng.random() ** 4)
            text.append(vocabulary[k])
        rows.append((i, " ".join(text)))
    return rows


def test_language_model(spark):
    rows = [*corpus(), (9000, None), (9001, ""), (9002, "A A a"), (None, "an er"), (9003, "x" * 50_000)]
    a, b = messy.thue_morse()
    seen_id, held_id = next(i for i in range(9100, 9200) if crc(i, 7) != 2), next(i for i in range(9100, 9200) if crc(i, 7) == 2)
    rows += [(seen_id, a), (held_id, b)]
    got = lm.score(messy.clash(spark.createDataFrame(rows, "doc_id long, text string")))
    counts = Counter()
    for i, t in rows:
        if crc(i, 7) != 2:
            counts.update([*messy.split(t), ""])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    result = got.collect()
    assert len(result) == len(rows)
    for r in result:
        toks = [*messy.split(texts[r.doc_id]), ""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(toks), sum(counts[w] > 0 for w in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks))
        assert r.score < 0
    p = {r.held_out: r for r in lm.perplexity(got).collect()}
    assert p[True].perplexity < p[True].base_perplexity


def test_blobs():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 9, 50), np.zeros(0, dtype=np.int32), rng.random(3).astype(np.float32), rng.integers(0, 2**63, 7).astype(np.uint64)]
    got = lm.unpack(lm.pack(*arrays))
    assert all((lm.sums_of(lm.steps_of(a)) == a).all() for a in arrays if a.dtype.kind != "f")
    assert [a.dtype for a in got] == [a.dtype for a in arrays] and all((a == b).all() for a, b in zip(got, arrays, strict=True))


def base_of(rows):
    """H of the distinct training words, and what is left for the unknown."""
    words = sorted({w for i, t in rows if crc(i, 7) != 2 for w in [*messy.split(t), ""]})
    unique, times = np.unique(seating.events(pa.array(words))[0], return_counts=True)
    model, p = seating.Spelling(unique, times, seating.CONTEXT, np.random.default_rng(6)), 0.0
    for turn in range(lm.SPELL_BURN_IN + lm.SPELL_SAMPLES):
        model.sweep()
        if turn >= lm.SPELL_BURN_IN:
            p = p + model.probabilities()[0] / lm.SPELL_SAMPLES
    h = seating.spell(pa.array(words), model.grams[0], np.log(p))
    return dict(zip(words, h, strict=True))


class Plain:
    """The model as it is written down: one customer at a time, in dictionaries."""

    def __init__(self, rows, seed):
        self.rng = random.Random(seed)
        self.h = base_of(rows)
        self.pairs = [(a, b) for i, t in rows if crc(i, 7) != 2 for ws in [messy.split(t)] for a, b in zip(["", *ws], [*ws, ""], strict=True)]
        d = lambda counts: seating.discount_of(sum(c == 1 for c in counts), sum(c == 2 for c in counts))
        self.d0, self.d1 = d(Counter(w for _, w in self.pairs).values()), d(Counter(self.pairs).values())
        self.rooms = defaultdict(lambda: defaultdict(list))  # of None: the words
        for a, b in self.pairs:
            self.add(a, b)

    def p(self, room, w):
        parent, d = (self.h.get(w, 1 - sum(self.h.values())), self.d0) if room is None else (self.p(None, w), self.d1)
        tables = self.rooms[room]
        mine, all_tables = tables.get(w, []), sum(len(x) for x in tables.values())
        return (sum(mine) - d * len(mine) + (1 + d * all_tables) * parent) / (1 + sum(sum(x) for x in tables.values()))

    def add(self, room, w):
        parent, d = (self.h[w], self.d0) if room is None else (self.p(None, w), self.d1)
        mine = self.rooms[room][w]
        weights = [x - d for x in mine] + [(1 + d * sum(len(x) for x in self.rooms[room].values())) * parent]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(mine):
            mine[k] += 1
        else:
            mine.append(1)
            if room is not None:
                self.add(None, w)

    def remove(self, room, w):
        mine = self.rooms[room][w]
        k = self.rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        if not mine[k]:
            mine.pop(k)
            if room is not None:
                self.remove(None, w)

    def sweep(self):
        for a, b in self.pairs:
            self.remove(a, b)
            self.add(a, b)


def test_scores_against_a_plain_model(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = ["ab", "b", "cab", "abba", "bac", "d", "da", "add"]
    rows = [(i, " ".join(vocabulary[int(8 * rng.random() ** 2)] for _ in range(rng.randint(1, 12)))) for i in range(40)]
    rows += [(500, "ab new d"), (501, "add add abba cab"), (502, "")]
    plain, p, many = Plain(rows, 1), defaultdict(float), 150
    texts = {i: [*messy.split(t)] for i, t in rows}
    for turn in range(many + 30):
        plain.sweep()
        if turn >= 30:
            for pair in {x for ws in texts.values() for x in zip(["", *ws], [*ws, ""], strict=True)}:
                p[pair] += plain.p(*pair) / many
    monkeypatch.setattr(lm, "SAMPLES", 10)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, ws in texts.items():
        want = sum(math.log10(p[x]) for x in zip(["", *ws], [*ws, ""], strict=True))
        assert got[i] == pytest.approx(want, abs=0.03 * (len(ws) + 1)), i


def test_probabilities_sum_to_one(spark):
    rows = corpus(n=60)
    vocabulary = sorted({w for i, t in rows if crc(i, 7) != 2 for w in messy.split(t)})
    context = Counter(w for i, t in rows if crc(i, 7) != 2 for w in messy.split(t)).most_common(1)[0][0]
    held = next(i for i in range(900, 999) if crc(i, 7) == 2)
    # every known word, an unknown one and the end come after the context, so its part knows them all
    text = " ".join(f"{context} {w}" for w in [*vocabulary, "neverseen"]) + f" {context}"
    model = lm.train(spark.createDataFrame([*rows, (held, text)], "id long, text string"))
    blobs = {(r["kind"], r["part"]): (lm.unpack_pairs if r["kind"] == "pairs" else lm.unpack)(r["blob"]) for r in model.state.collect()}
    seen = 0
    for (kind, part), blob in blobs.items():
        if kind != "pairs":
            continue
        contexts, words, _, vi, wi, c = blob
        seats, (times, h) = blobs["seats", part], blobs["counts", part]
        if (times > 0).sum() != len(vocabulary) + 1:
            continue
        # the known words, and one for all unknown
        events = np.append(np.flatnonzero(times > 0), np.flatnonzero(times == 0)[0])
        for x in range(len(contexts)):
            mine, p = vi == x, 0.0
            for k, sample in enumerate(model.sums["samples"]):
                tables, wc, wt = seats[2 + 3 * k : 5 + 3 * k]
                p_word = lm.word_probability(wc, wt, h.astype(float), sample, times > 0)
                cs, ts = np.zeros(len(words)), np.zeros(len(words))
                cs[wi[mine]], ts[wi[mine]] = c[mine], tables[mine]
                p += lm.predictive(cs, ts, c[mine].sum(), tables[mine].sum(), p_word, model.sums["d1"])[events].sum() / lm.SAMPLES
            assert p == pytest.approx(1.0, abs=1e-4)
            seen += 1
    assert seen


def test_hot_contexts_and_rare_words(spark, monkeypatch):
    """A context with more tokens than a part is split by the word after it; rare words have no number."""
    docs = spark.createDataFrame(corpus(n=120), "doc_id long, text string")
    whole = {r.doc_id: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 50)
    monkeypatch.setattr(lm, "PART_TOKENS", 400)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 60)
    for r in lm.score(docs).collect():
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens) and r.base_score == pytest.approx(w.base_score)
        assert r.score == pytest.approx(w.score, abs=0.06 * r.n_tokens)


def test_another_layout_of_files_scores_alike(spark):
    docs = spark.createDataFrame(corpus(n=60), "doc_id long, text string")
    a, b = ({r.doc_id: round(r.score, 6) for r in lm.score(docs.repartition(n)).collect()} for n in (2, 5))
    assert a == b


def test_a_text_that_comes_twice_is_told_apart(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    both = [i for i in range(20) if crc(i, 7) != 2 and crc(1000 + i, 7) != 2]
    once = [got[i] for i in range(20, 150) if crc(i, 7) != 2]
    assert min(got[i] for i in both) > max(once)


def test_spelling_is_a_distribution():
    unique, times = np.unique(seating.events(pa.array(["ab", "abc", "b", "", "bab", "ab"]), 2)[0], return_counts=True)
    assert times.sum() == 17
    model = seating.Spelling(unique, times, 2, np.random.default_rng(1))
    for _ in range(3):
        model.sweep()
    p = model.probabilities()[0]
    room = unique >> 9
    for r in np.unique(room):
        assert 0 < p[room == r].sum() < 1


def seatings(customers, base, discount, others):
    """The exact distribution of the tables of a dish, from all seatings."""
    weight = Counter()

    def go(left, sizes, w):
        if not left:
            weight[len(sizes)] += w
            return
        go(left - 1, [*sizes, 1], w * (seating.STRENGTH + discount * (others + len(sizes))) * base)
        for k in range(len(sizes)):
            go(left - 1, [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], w * (sizes[k] - discount))

    go(customers, [], 1.0)
    return {t: w / sum(weight.values()) for t, w in weight.items()}


def test_gibbs_sweeps_have_the_exact_distribution():
    n, rng = 3000, np.random.default_rng(2)
    room, base = np.arange(n), np.full(n, 0.05)
    seats = seating.Seats.start(np.full(n, 6), room, base, 0.5, rng)
    in_room, found = 40.0 + seats.tables, Counter()
    for turn in range(50):
        seats.sweep(room, in_room, base, 0.5, rng)
        assert (seats.customers() == 6).all() and (in_room == 40 + seats.tables).all() and (seats.sizes > 0).all()
        if turn >= 15:
            found.update(seats.tables.tolist())
    for t, p in seatings(6, 0.05, 0.5, 40).items():
        assert found[t] / sum(found.values()) == pytest.approx(p, abs=0.01)
    wanted = rng.integers(0, 12, n)
    wanted[:3] = 5000, 700, 90
    seats.become(wanted, room, in_room, base, 0.5, rng)
    assert (seats.customers() == wanted).all() and (in_room == 40 + seats.tables).all()
    wanted[:3] = 100, 2, 9
    seats.become(wanted, room, in_room, base, 0.5, rng)
    assert (seats.customers() == wanted).all() and (in_room == 40 + seats.tables).all() and (seats.sizes > 0).all()


def test_a_sweep_moves_all_customers_of_frequent_dishes():
    """From one table each, sweeps come to where steps of one customer at a time come."""
    n, size, rng = 2000, 100, np.random.default_rng(5)
    room, base, found = np.arange(n), np.full(n, 0.05), []
    for plain in (False, True):
        seats, in_room = seating.Seats(np.ones(n), np.full(n, size)), np.full(n, 101.0)
        for _ in range(12):
            if plain:
                seats.steps(np.full(n, size), True, True, room, in_room, base, 0.5, rng)
            else:
                seats.sweep(room, in_room, base, 0.5, rng)
            assert (seats.customers() == size).all() and (in_room == 100 + seats.tables).all() and (seats.sizes > 0).all()
        found.append(seats.tables.mean())
    assert found[0] == pytest.approx(found[1], rel=0.05)


def test_no_training_rows(spark):
    one = next(i for i in range(100) if crc(i, 7) == 2)
    got = lm.score(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
    assert lm.score(messy.empty(spark)).count() == 0


def test_a_lot_of_very_many_words():
    """More different words than 22 bits number: every pair is still its own, in the right row."""
    n = (1 << 22) + 5000
    h = np.random.default_rng(4).permutation(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    none = np.zeros(0, dtype=np.uint64)
    dealer = lm.Dealer(none, none, np.zeros(0), none, np.zeros(0, dtype=np.int64), 4)
    known, base, blobs = dealer.lot(h, np.array([n - 7, 0, 7]), np.array([1, 1, 0]))
    assert not known.any() and not base.any()
    edge = dealer.edge
    ids = [lm.word_ids(np.concatenate(x), none, none) for x in ((edge, h[:-7], edge), (edge, edge), (edge, h[-7:], edge))]
    code = lambda v, w: tk.mix(v) ^ (w * np.uint64(3))
    want = np.sort(np.concatenate([code(x[:-1], x[1:]) for x in ids]))
    got, learned, in_row = [], 0, np.zeros(3, dtype=np.int64)
    for _, pairs, entries, _ in blobs:
        v, w, c = lm.unpack(pairs)
        many, row, times = lm.unpack(entries)
        assert many.sum() == len(row)
        got.append(code(v, w))
        learned += int(c.sum())
        in_row += np.bincount(row, weights=times, minlength=3).astype(np.int64)
    assert (np.unique(want) == np.sort(np.concatenate(got))).all()
    assert in_row.tolist() == [n - 6, 1, 8] and learned == n - 5
