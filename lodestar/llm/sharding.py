"""Contiguous shards of near equal bytes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group are numbered in so many independent parts.
PARTS = 256
#: Share of a shard's target up to which a group of equal texts is not cut.
WHOLE = 0.1


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: (id, size, text_crc32, law, shard, slot, grown_shard).

    The global order is (hash of the text, part, id). Totals of groups of equal
    texts are summed in ranges of that order, range totals are prefix-summed
    (a table of at most 4,096 rows), and shards are cut at equal targets of
    bytes: contiguous in the order and near equal. A group of up to ``WHOLE``
    of a target goes as one to the shard in which its middle falls, so equal
    texts stay together; a larger one is cut between its rows where a target
    ends. Slots are gapless from 0 in each shard.

    A large group is never gathered: its rows are counted and numbered in
    ``PARTS`` parts by a hash of the id. A null text equals an empty one, of
    ``overhead`` bytes a row and CRC 0; null ids count as an id. Repeated rows
    get slots of their own. An empty table gives an empty result. With fewer
    groups than shards some shards are empty.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
        F.md5(F.coalesce(text, F.lit(""))).alias("g"),
    ).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("range", F.substring("g", 1, 3))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = groups.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("bytes").alias("rb"))
    over_all = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("rn").over(over_all), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("rb").over(over_all), F.lit(0)).alias("b0"),
        F.sum("rb").over(whole).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        groups.withColumn("gn", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("gb", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .join(F.broadcast(ranges), "range")  # at most 4,096 rows: three hex digits
        .select("g", "bytes", "total", (F.col("n0") + F.col("gn")).alias("first"), (F.col("b0") + F.col("gb")).alias("begin"))
    )
    by_part = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("g", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("pn")).join(placed, "g")
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy("id")) - 1
    inner = F.col("pn") + F.col("nth")
    # rows of a group are alike in size, so a row's bytes begin at its number times that
    whole_group = F.col("bytes") * shards <= F.col("total") * WHOLE
    middle = F.col("begin") + F.when(whole_group, F.col("bytes") / 2).otherwise((inner + F.lit(0.5)) * F.col("size"))
    numbered = (
        rows.withColumn("nth", nth).join(offsets, ["g", "part"])
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int"))
        .select("id", "size", "crc", "shard", (F.col("first") + inner).alias("place"))
    )
    starts = numbered.groupBy("shard").agg(F.min("place").alias("start"))
    return numbered.join(F.broadcast(starts), "shard").select(  # one row a shard
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
