"""Tables that the deduplications keep in the shared folder."""

from __future__ import annotations

from lodestar.llm import exact_dedup, ngram_join, runtime


def _docs(spark):
    text = "one two three four five six seven eight nine ten"
    return spark.createDataFrame([(1, text), (2, text.upper()), (3, f"{text} eleven"), (4, None), (5, "other words of another text that stands alone here")], "doc_id long, text string")


def test_exact_deduplication_keeps_a_text_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df, tag: kept.append(df.schema) or runtime.cut(df, tag))
    out = exact_dedup.deduplicate(_docs(spark))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]
    assert [f.name for f in kept[0]] == ["row", "id", "h", "again"]


def test_near_deduplication_keeps_no_shingles(spark):
    before = set(runtime._made)
    out = ngram_join.near_duplicates(_docs(spark), width=5)
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in set(runtime._made) - before]
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert not {"prefixes", "classes", "shared", "labelled", "open"} & set(left)


def test_hubs_and_their_entries_read_one_shuffle(spark, monkeypatch):
    plans = []

    def cut(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return runtime.cut(df, tag)

    monkeypatch.setattr(ngram_join, "cut", cut)
    ngram_join.near_duplicates(_docs(spark), width=5)
    plan = next(p for tag, p in plans if tag == "shared")
    assert plan.count("Exchange hashpartitioning(tok") == 2 == plan.count("REPARTITION_BY_COL")


def test_pairs_are_verified_from_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "cut", lambda df, tag: made.append((tag, df.columns)) or runtime.cut(df, tag))
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} more"), (3, text.replace("word30", "other")), (3, text), (3, text)], "doc_id long, text string")
    out = ngram_join.near_duplicates(docs, width=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(1, 59, 1), (2, 60, 1), (3, 59, 1), (3, 59, 1), (3, 59, 1)]
    assert not [tag for tag, columns in made if "seconds" in columns]  # no table of both hashes of whole sets
    assert ["id", "text"] in [columns for _, columns in made] and "met" in [tag for tag, _ in made]
