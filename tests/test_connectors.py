"""The data source of external stores, on a database file of the standard library."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, In, LessThan, StringStartsWith

from lodestar.operators import graph
from lodestar.sources import connectors, stores

KINDS = "id long, name string, v array<double>, ok boolean, n int, x double"


@pytest.fixture
def at(tmp_path):
    return {"module": "sqlite3", "connect": json.dumps({"database": str(tmp_path / "store.db"), "timeout": 60})}


def ask(at, sql):
    with sqlite3.connect(**json.loads(at["connect"])) as c:
        return c.execute(sql).fetchall()


def tables(at):
    return {x for x, in ask(at, "SELECT name FROM sqlite_master WHERE type = 'table'")}


def test_round_trip(spark, at):
    rows = [(i, f"name {i} ' 가", [i / 3, -1.0], i % 2 == 0, i, i / 7) for i in range(1000)] + [(None, None, None, None, None, None), (1 << 60, "", [], True, -1, 0.0)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    connectors.save(df, at, "things", batch=70)
    for parts in (1, 4, 9):
        got = connectors.load(spark, at, "things", KINDS, partition_column="id", partitions=parts, batch=33)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert connectors.load(spark, at, "things", "name string").where("name = ''").count() == 1
    assert tables(at) == {"things"}  # nothing staged is left


def test_partitions_cover_every_value(spark, at):
    connectors.save(spark.createDataFrame([(5,), (5,), (7,), (None,)], "id long"), at, "few")
    schema = T.StructType([T.StructField("id", T.LongType())])
    for parts in (1, 2, 3, 50):
        reader = connectors.Reader(schema, {**at, "table": "few", "partition_column": "id", "partitions": str(parts)})
        assert sorted((x for p in reader.partitions() for x, in reader.read(p)), key=str) == [5, 5, 7, None]


def test_keys_are_merged_and_older_rows_stay_out(spark, at):
    kind = "chunk_id string, v array<double>, version long"
    connectors.upsert_vectors(spark.createDataFrame([("a", [1.0], 3), ("b", [2.0], 1), ("b", [9.0], 2)], kind), at)
    connectors.upsert_vectors(spark.createDataFrame([("a", [7.0], 2), ("b", [4.0], 5), ("c", [0.5], 1)], kind), at)
    got = {r.chunk_id: (r.v, r.version) for r in connectors.read_vectors(spark, at).collect()}
    assert got == {"a": ([1.0], 3), "b": ([4.0], 5), "c": ([0.5], 1)}
    near = stores.query(connectors.read_vectors(spark, at), spark.createDataFrame([("q", [1.0])], "qid string, q array<double>"), 1).collect()
    assert [r.rank for r in near] == [1]


def test_a_failing_batch_aborts(spark, at):
    good = spark.createDataFrame([(i, "x") for i in range(50)], "id long, name string")
    connectors.save(good, at, "kept", "id")
    bad = spark.range(1000).select(F.when(F.col("id") != 700, F.col("id") + 100).alias("id"), F.lit("y").alias("name")).repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="a null in the key"):
            connectors.save(bad, at, "kept", "id", mode, batch=10)
        assert ask(at, "SELECT COUNT(*), MAX(name) FROM kept") == [(50, "x")] and tables(at) == {"kept"}
    connectors.save(good.where("id < 3"), at, "kept", "id", "overwrite")
    assert ask(at, "SELECT COUNT(*) FROM kept") == [(3,)]


def test_attempts_that_were_not_taken_leave_nothing(at):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    writer = connectors.Writer(schema, {**at, "table": "once", "batch": "2"}, False)
    writer.write(iter([(k, "lost") for k in range(5)]))
    taken = writer.write(iter([(k, "taken") for k in range(5)]))
    assert taken.rows == 5
    writer.commit([taken, None])
    assert ask(at, "SELECT name, COUNT(*) FROM once GROUP BY name") == [("taken", 5)] and tables(at) == {"once"}


def test_a_failing_commit_changes_nothing(at):
    schema = T.StructType([T.StructField("id", T.LongType())])
    ask(at, "CREATE TABLE strict (id BIGINT CHECK (id < 10))")
    ask(at, "INSERT INTO strict VALUES (1)")
    writer = connectors.Writer(schema, {**at, "table": "strict"}, True)
    message = writer.write(iter([(2,), (20,)]))
    with pytest.raises(sqlite3.IntegrityError):
        writer.commit([message])
    writer.abort([message])
    assert ask(at, "SELECT id FROM strict") == [(1,)] and tables(at) == {"strict"}


def test_filters_reach_the_store(spark, at):
    connectors.save(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id long, name string"), at, "some")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    reader = connectors.Reader(schema, {**at, "table": "some"})
    left = list(reader.pushFilters([EqualTo(("name",), "a"), LessThan(("id",), 6), In(("id",), (0, 1, 4, 8)), StringStartsWith(("name",), "a"), LessThan(("name",), "b")]))
    assert [type(f) for f in left] == [StringStartsWith, LessThan]
    assert sorted(reader.read(connectors.Range())) == [(0, "a"), (4, "a")]
    got = connectors.load(spark, at, "some", "id long, name string").where("name = 'b' and id >= 5 and name like 'b%'")
    assert sorted(r.id for r in got.collect()) == [5, 7, 9]


def test_graph(spark, at):
    rows = [("a", "r1", "b"), ("b", "r2", "c"), ("c", "r1", "d"), ("a", "r1", "b")]
    relations = spark.createDataFrame(rows, connectors.RELATION)
    for _ in range(2):  # loading again changes nothing
        connectors.write_graph(relations, at, batch=2)
        assert sorted(map(tuple, connectors.read_graph(spark, at).collect())) == sorted(set(rows))
        assert ask(at, "SELECT COUNT(*) FROM entity") == [(4,)]
    connectors.write_graph(spark.createDataFrame([("d", "r2", "e")], connectors.RELATION), at, "append")
    assert connectors.read_graph(spark, at).where("rtype = 'r2'").count() == 2
    seeds = spark.createDataFrame([("s", "a")], "qid string, eid string")
    held, plain = connectors.read_graph(spark, at), spark.createDataFrame([*rows, ("d", "r2", "e")], connectors.RELATION).distinct()
    assert sorted(map(tuple, graph.expand(seeds, held, 3).collect())) == sorted(map(tuple, graph.expand(seeds, plain, 3).collect()))


def test_nothing_is_assumed(spark, at, monkeypatch):
    df = spark.createDataFrame([(1,)], "id long")
    for gone in ("module", "connect"):
        with pytest.raises(Exception, match=f"needs the options {gone}"):
            connectors.save(df, {k: v for k, v in at.items() if k != gone}, "t")
    with pytest.raises(Exception, match="unable to open"):
        connectors.save(df, {**at, "connect": json.dumps({"database": "/no/such/folder/x.db"})}, "t")
    with pytest.raises(Exception, match="not a plain name"):
        connectors.save(df, at, "t; DROP TABLE x")
    with pytest.raises(Exception, match="no such column"):
        connectors.save(df, at, "t", "other")
    with pytest.raises(Exception, match="holds no column of date"):
        connectors.save(df.select(F.current_date().alias("d")), at, "t")
    monkeypatch.delenv("LODESTAR_STORE_MODULE", raising=False)
    with pytest.raises(RuntimeError, match="LODESTAR_STORE_MODULE"):
        connectors.from_env()
    monkeypatch.setenv("LODESTAR_STORE_MODULE", "sqlite3")
    monkeypatch.setenv("LODESTAR_STORE_CONNECT", "{}")
    assert connectors.from_env() == {"module": "sqlite3", "connect": "{}"}


def test_empty(spark, at):
    connectors.save(spark.createDataFrame([], "id long, name string"), at, "none", "id")
    assert connectors.load(spark, at, "none", "id long, name string", partition_column="id", partitions=4).collect() == []
