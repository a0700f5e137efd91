"""Exact deduplication by content hash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def content_hash(norm: Column) -> Column:
    """The 128-bit hash that rows are grouped by."""
    return F.md5(norm)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Rows are grouped by a 128-bit hash of the normalised text *and* the text
    itself, so the grouping compares bytes. Copies combine on the map side: a
    group of any size leaves one row per task. Where a hash has one text, which
    the grouping has proven, its rows find their class by the hash alone, so texts
    move once. Where a hash has several texts, its rows, and only these, are
    grouped and joined by the text again.

    ``keep`` is ``smallest`` or ``largest``: which id of a group stays.
    A null text equals an empty one. Null ids lose to any other id; a group of
    null ids keeps a null. Of repeated rows (same id and text) exactly one is
    ``kept``; each still has its own result row. Very long texts are hashed and
    compared whole. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), fold_ascii(F.col(text_col)).alias("norm")).withColumn("h", content_hash(F.col("norm")))
    texts = rows.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = cut(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "hashes")
    # rows without their texts; repeated rows combine, so a hot group leaves a row for each id
    members = rows.select("h", "id", F.sha2("norm", 256).alias("sha")).groupBy("h", "id", "sha").agg(F.count(F.lit(1)).alias("times"))
    found = members.join(by_hash.where("texts = 1").drop("texts"), "h").select("id", "sha", "times", "keep_id", "group_size")
    collided = by_hash.where("texts > 1").select("h")
    if collided.limit(1).count():
        again = rows.join(collided, "h", "left_semi")
        classes = again.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = again.groupBy("h", "norm", "id").agg(F.count(F.lit(1)).alias("times")).join(classes, ["h", "norm"])
        found = found.unionByName(again.select("id", F.sha2("norm", 256).alias("sha"), "times", "keep_id", "group_size"))
    out = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts, with all columns.

    Rows whose hash no other row has stay without a further look; hashes are
    counted first, from rows without texts, so whole rows move once. The others
    are grouped by hash and text, which compares bytes, and the row of the
    smallest (or largest) id is the group's.

    A null text equals an empty one. A null id loses to any other. Where one id
    repeats with the same text, one of its rows stays. Very long texts are
    compared whole. An empty table gives an empty result. Columns may have any
    names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), content_hash(fold_ascii(F.col(text_col))).alias("h"))
    name = docs.select(text_col).columns[0]  # a row has its text once
    several = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # large groups are split in this join by adaptive execution; nothing is aggregated after it
    marked = cut(rows.join(several, "h", "left").select("row", "id", "h", F.col("n").isNotNull().alias("again")), "marked")
    alone = marked.where("not again").select("row.*")
    best = F.min_by if keep == "smallest" else F.max_by
    order = F.struct((F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()).alias("first"), "id")
    one = marked.where("again").groupBy("h", fold_ascii(F.col("row")[name]).alias("norm")).agg(best("row", order).alias("row"))
    return alone.unionByName(one.select("row.*"))
