"""Stores of chunks, vectors, postings and relations as Parquet tables."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import iri
from lodestar.operators.dense import exact_topk
from lodestar.operators.graph import adjacency
from lodestar.operators.lexical import LexicalIndex
from lodestar.operators.segments import Segments
from lodestar.plans.lineage import cut


def upsert(held: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "version") -> DataFrame:
    """Rows of both, the latest ``order`` of each key; among equals the new one."""
    both = held.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r", "__new")


def get(held: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return held.join(ids.select(key).distinct(), key, "left_semi")


def query(held: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, chunk_id, distance, rank): the nearest by cosine distance of unit vectors."""
    return exact_topk(queries, held.select("chunk_id", "v"), n).select("qid", "chunk_id", (1 - F.col("score")).alias("distance"), "rank")


def distinct_relations(relations: DataFrame) -> DataFrame:
    """Set semantics of graph stores: each relation once."""
    return relations.select("head", "rtype", "tail").distinct()


def write_relations(relations: DataFrame, path: str) -> None:
    """Overwrites a graph, a folder a relation type, so that readers of one type read only it."""
    distinct_relations(relations).write.mode("overwrite").partitionBy("rtype").parquet(path)


def load_relations(relations: DataFrame, path: str) -> int:
    """Adds the relations that a graph does not hold yet, a folder a type; how many they were.

    Loading the same again adds nothing. The new rows are found before anything is written.
    """
    spark = relations.sparkSession
    new = distinct_relations(relations)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(read_relations(spark, path), ["head", "rtype", "tail"], "left_anti")
    new = cut(new)
    n = new.count()
    if n:
        new.repartition("rtype").write.mode("append").partitionBy("rtype").parquet(path)
    return n


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents, one a line; a line that is none raises when read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("head", "rtype", "tail")


def as_triples(relations: DataFrame) -> DataFrame:
    """(s, p, o) with percent-encoded names, once each."""
    return relations.select(iri(F.col("head")).alias("s"), iri(F.col("rtype"), "urn:relation:").alias("p"), iri(F.col("tail")).alias("o")).distinct()


def write_index(index: LexicalIndex | Segments, path: str) -> None:
    for field in fields(index):
        table = getattr(index, field.name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{field.name}")


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats", "chunks")))


def read_segment(spark: SparkSession, path: str) -> Segments:
    return Segments(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "members")))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_demo(relations: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eid, json) of neighbours and (qid, json) of results, one document a line."""
    a = adjacency(relations).select("eid", F.to_json(F.struct("neighbours")).alias("json"))
    return a, lists.select("qid", F.to_json(F.struct("retrieved")).alias("json"))
