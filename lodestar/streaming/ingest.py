"""Continuous ingestion: new documents are chunked and upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.chunking import chunk


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, size: int = 1000, overlap: int = 150) -> StreamingQuery:
    """Reads Parquet files of documents (doc_id, text, version) from ``source`` and keeps ``target`` up to date.

    Each batch writes a new generation of the chunk table beside the last one,
    so a batch that is repeated after a failure gives the same table. Of the rows
    of a document in one batch the latest version counts (of equal ones, the larger
    text), and it replaces what the table holds unless that is of a later version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        latest = batch.groupBy("doc_id").agg(F.max(F.struct("version", "text")).alias("r")).select("doc_id", "r.version", "r.text")
        if number:
            held = own.read.parquet(f"{target}/generation={number - 1}")
            known = held.groupBy("doc_id").agg(F.max("version").alias("held_version"))
            latest = latest.join(known, "doc_id", "left").where(F.col("held_version").isNull() | (F.col("version") >= F.col("held_version"))).drop("held_version")
        new = chunk(latest, size, overlap).join(latest.select("doc_id", "version"), "doc_id")
        if number:
            # chunks of a document that arrives again go, however many it had
            new = held.join(latest.select("doc_id"), "doc_id", "left_anti").select(new.columns).unionByName(new)
        new.write.mode("overwrite").parquet(f"{target}/generation={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
