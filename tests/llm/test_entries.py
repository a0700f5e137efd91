"""Every registered query of the subpackage on a small folder, with the SQL of those that have it."""

from collections import Counter

import duckdb
import pytest

from lodestar.llm import queries
from tests.llm import messy

#: Columns that the contracts name; more may follow.
COLUMNS = {
    "op1_ngram_join": "doc_id n_shingles component_id", "op2_mix": "doc_id size source_size target taken", "op3_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_lm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op7_quality": "doc_id held_out score predicted",
    "op8_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_langid": "doc_id held_out lang_pred score", "op10_ann": "query_id rank vec_id score",
    "op11_divergence": "lang source part item value rank", "op12_search": "item_id rank doc_id score", "op13_simhash": "doc_id fingerprint component_id",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with unique ids, as the driver's have; all else is as odd as in the other tests."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = list({r[0]: r for r in messy.rows(seed=3, n=80) if r[0] is not None}.values())
    docs = spark.createDataFrame(rows, messy.SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://x/{i}" if i % 7 else None, None if i == 3 else f"<p>{'é' * (i % 4)} {i % 11}</p>") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, None if i == 5 else [float((i * k) % 13 - 6) for k in range(1, 9)]) for i in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    items = [(k, t) for k, t in enumerate([rows[0][1], rows[7][1], None, "", "no such words"])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def value(x):
    return None if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    path, rows = folder
    got = queries.QUERIES[name](spark, path)
    wanted = COLUMNS[name].split()
    assert got.columns[: len(wanted)] == wanted
    found = got.collect()
    if "doc_id" in wanted and name not in ("op8_pack", "op12_search"):
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    if name == "op8_pack":
        assert Counter(r.doc_id for r in found if r.start == 0) == Counter(r[0] for r in rows)
    if name == "op10_ann":
        assert Counter(r.query_id for r in found) == Counter({i: 20 for i in range(0, 100, 20)})
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        cursor = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert Counter(tuple(value(r[c]) for c in names) for r in found) == Counter(tuple(value(x) for x in r) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_of_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", messy.SCHEMA), ("labels", "doc_id long, quality int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_another_session_setting_stays(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    queries.op6_lm(spark, folder[0]).count()
    from lodestar.llm import runtime

    assert spark.conf.get(key) == str(runtime.ARROW_ROWS)
