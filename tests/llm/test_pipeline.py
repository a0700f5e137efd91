"""The whole pipeline against a plain version of its stages."""

import random
from collections import Counter

import corpus_pipeline
from lodestar.llm import langid, mixing, packing
from tests.llm import messy
from tests.llm.test_models import LANGS, speech
from tests.llm.test_native import plain_targets
from tests.llm.test_pairs import plain


def write(spark, path, n=120):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        t = speech(rng, lang, rng.randint(20, 60))
        if rows and rng.random() < 0.4:
            t = rng.choice(rows)[1]
            if rng.random() < 0.5:
                t += " " + speech(rng, lang, 1)
            elif rng.random() < 0.5:
                t = t.upper()
        rows.append((i, t, lang, rng.choice(["a", "b", "c", None]), len(t)))
    rows += [(900, None, "en", "a", None), (901, "", "en", "a", 0), (902, "12 34", "en", "b", 5)]
    spark.createDataFrame(rows, messy.SCHEMA).write.parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = stages[name] = spark.read.parquet(f"{tmp_path}/stage{k}")
    ids = lambda s: sorted(r.doc_id for r in stages[s].select("doc_id").collect())
    named = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, messy.SCHEMA)).collect()}
    kept = [r for r in rows if named[r[0]].lang_pred != "und"]
    assert ids("language identification") == sorted(r[0] for r in kept) and len(kept) == len(rows) - 3
    once = {}
    for r in kept:
        once.setdefault(messy.fold(r[1]), r)
    kept = list(once.values())
    assert ids("exact deduplication") == sorted(r[0] for r in kept) and len(kept) < len(rows) - 3
    least = {c for _, _, c in plain(kept, 5, 80, 100)}
    near = [r for r in kept if r[0] in least]
    assert ids("near deduplication") == sorted(r[0] for r in near) and len(near) < len(kept)
    sizes, taken = Counter(), Counter()
    by_id = {r[0]: r for r in near}
    for r in near:
        sizes[r[3]] += len(messy.split(r[1]))
    mixed = Counter(ids("mixing"))
    for i, times in mixed.items():
        taken[by_id[i][3]] += times * len(messy.split(by_id[i][1]))
    for s, want in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - want) <= 40
    packed = stages["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == mixed
    full = Counter()
    for r in packed:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= packing.WINDOW


def test_run(spark, tmp_path):
    write(spark, str(tmp_path), 40)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and "sequence_id" in got.columns


def test_odd_documents(spark, tmp_path):
    """Null ids and languages, repeated rows, very long texts, clashing columns: every stage keeps the columns and runs."""
    messy.documents(spark, n=100).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()})
    first = {(i, t) for i, t, *_ in messy.rows(n=100)}
    assert seen[0] == {(i, t) for i, t in first if t is not None and any(c.isalpha() for c in t)}
    assert seen[1] <= seen[0] and {messy.fold(t) for _, t in seen[1]} == {messy.fold(t) for _, t in seen[0]}
    assert seen[2] <= seen[1] and seen[3] <= seen[2] and (None, "no id here at all") in seen[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()).keys() == {i for i, _ in seen[3]}


def test_empty_documents(spark, tmp_path):
    messy.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_stage_repeats(spark):
    rows = [(i, "one two three", "en", "a" if i < 3 else "b", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, messy.SCHEMA)
    times = Counter(r.source for r in mixing.apply(docs).collect())
    assert times == Counter({"a": 9, "b": 21})
