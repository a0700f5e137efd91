"""Session settings that the operators are planned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and sizes partitions; the rest keeps tasks within memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it was imported from without being on their path.

    That serves workers that share the driver's files; a cluster gets the package
    with ``--py-files`` or an installed one.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def session(name: str = "lodestar", shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the settings; on a cluster give ``spark.checkpoint.dir`` a shared folder."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship(builder.getOrCreate())
