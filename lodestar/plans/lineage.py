"""Cutting the plans of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
_owners = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made for a local master; on a
    cluster it would be one machine's own, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def _delete(path: str) -> None:
    spark = _made.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


@contextmanager
def owned() -> Iterator[None]:
    """Tables that are cut inside, in this thread, go at the end: whatever reads them must be collected or written by then."""
    outer, _owners.paths = getattr(_owners, "paths", None), []
    try:
        yield
    finally:
        for path in _owners.paths:
            _delete(path)
        _owners.paths = outer


def held_tables() -> int:
    """How many tables exist that were cut and have not gone."""
    return len(_made)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: no lineage behind it, and later plans prune its columns.

    Tables go when the driver exits, or at the end of ``owned``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _made[path] = spark
    if getattr(_owners, "paths", None) is not None:
        _owners.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Adds consecutive numbers in a global order, without one task that sorts all rows.

    Rows are dealt by range, ranges are cut from their lineage so that both
    readers see the same, each range is numbered on its own, and the sizes of
    the ranges before it are added.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))  # one row a range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + nth - 1 + start).drop("__range", "__before")
