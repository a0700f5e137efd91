"""Session helpers shared by the operators: lineage cuts and Arrow limits."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import ship

#: Rows of one Arrow batch handed to a Python worker. Texts can be long, so a
#: batch stays small; kernels split it further by bytes.
ARROW_ROWS = 512

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made for a local master; on a
    cluster it would be one machine's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers receive, and lets them find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` for the jobs that run inside: for tables of short values."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


atexit.register(_delete_all)


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    The new frame has no lineage behind it, so a lost executor costs a reread,
    and shuffle files of what came before can go. ``by`` is a column whose values
    get folders of their own, for ``drop_kind``.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    del df  # the last reference, where the caller gave the frame no name: its shuffle files go now, not at the next table
    sweep(spark)
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and broadcasts no longer referenced."""
    gc.collect()  # drops the Python references, whose Java objects the cleaner then finds
    spark.sparkContext._jvm.System.gc()


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind frames from ``cut`` that no later plan reads."""
    for df in frames:
        path = df._cut_path
        _delete(df.sparkSession, path)
        _made.pop(path, None)


def drop_kind(df: DataFrame, kind: str) -> None:
    """Deletes the rows of one kind of a frame from ``cut(..., by="kind")``; later plans must filter it out."""
    _delete(df.sparkSession, f"{df._cut_path}/kind={kind}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path from ``table_path``."""
    _delete(spark, path)
    _made.pop(path, None)


def tree_sum(parts: DataFrame, add, schema: str, *keys: str, fan: int = 32) -> DataFrame:
    """Adds the tables that tasks have made, ``fan`` at a time, until one is left (of each ``keys``).

    ``add`` takes a pandas frame of some rows of one key and returns one row.
    However many tasks there are, no task holds more than ``fan`` tables.
    """
    n = parts.rdd.getNumPartitions()
    out = parts.withColumn("lot", F.spark_partition_id())

    def level(pdf):
        lot = pdf["lot"].iloc[0]
        one = add(pdf)
        one["lot"] = lot
        return one

    while True:
        n = -(-n // fan)
        out = out.withColumn("lot", F.floor(F.col("lot") / fan).cast("int")).groupBy(*keys, "lot").applyInPandas(level, f"{schema}, lot int")
        if n <= 1:
            return out.drop("lot")


def take_by_hash(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of their id: the same at every run.

    Rows are thinned by their hash before they are sorted, so however many there
    are, about ``most`` reach the sort.
    """
    n = rows.count()
    h = F.xxhash64(id_col)
    if n > 2 * most:
        # at least `most` pass: the bound is 16 standard deviations above it
        share = (most + 16 * most**0.5) / n
        rows = rows.where(F.shiftrightunsigned(h, 33) < int(share * 2**31))
    return rows.orderBy(F.shiftrightunsigned(h, 33), h, id_col).limit(most)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
