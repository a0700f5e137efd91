"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Keys are summed in ranges, a sixteenth of a doubling each, and those in PARTS parts, before any rows are sorted.
RANGES, PARTS = 16, 512


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A weight from 0.1 to 1: how much a text of ``size`` words looks like prose.

    It falls with the share of characters that are neither letters, digits nor
    white space (0 at a quarter of them), and with the distance of the mean word
    length from six characters. Null and wordless texts have 0.1.
    """
    chars = F.greatest(F.length(text), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / chars
    plain = F.greatest(F.lit(0.0), F.lit(1.0) - marks * 4)
    words = F.exp(-F.pow((chars / F.greatest(size, F.lit(1)) - 6.0) / 4.0, F.lit(2.0)))
    return F.lit(0.1) + 0.9 * F.when(size > 0, plain * words).otherwise(F.lit(0.0))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> also ``target``: the water level of the weights under the caps.

    Sources by code point, null last, weigh ``weights`` in turn. Sharing the
    whole by weight, holding sources at ``cap`` times their size and resharing
    the excess until none is above is the level L at which the sum of
    min(cap * size, L * weight) is the whole. Sorted by cap/weight, the held
    sources come first, so one pass over the table of sources finds L.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("held", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("free_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(all_rows))
    )
    # the level if all sources before this one are held and no other is; it is
    # the true one at the first source that it leaves under its cap
    s = s.withColumn("level", (F.col("total") - F.col("held")) / F.col("free_w"))
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("most"))
    s = s.withColumn("the_level", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(all_rows)["level"])
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("the_level") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 20, quality: Column | None = None) -> DataFrame:
    """One row per input row: (id, source, size, source_size, target, times, taken).

    Every source first gives its complete epochs, floor(target / source_size).
    What is left of its budget goes by Efraimidis-Spirakis sampling without
    replacement: a row's key is an exponential variate, from a hash of its id,
    divided by its quality weight (``quality``, a positive column over ``docs``;
    by default ``text_quality``). Rows are taken in key order while the middle of
    a row lies within the budget.

    Texts are read once, into a table of ids, sizes and keys. No source is sorted
    as a whole: keys are summed in ranges of their logarithm, two levels of them,
    with map-side combining; prefix sums over the ranges, and over the parts of
    the one in which a source's budget ends, find the part in which it does, and
    only rows of that part are sorted. Parts before it are taken whole and those
    after it not at all. A part is ``RANGES * PARTS`` to a doubling of the key.
    As an exponential variate falls between x and x(1 + d) with a probability of
    at most d/e whatever its rate, a part is expected to hold at most a 32,000th
    of a source, for any quality weights.

    Null or wordless texts have size 0 and are never taken by words (taken 0).
    A null source is a source. Repeated rows are rows of their own; their keys
    are equal, and those of null ids are drawn by the text, so only rows alike in
    both share one. Very long texts are rows like others. An empty table gives an
    empty result. Other columns are ignored, whatever their names. Reruns agree.
    """
    size = n_words(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), size.alias("size"), (F.lit(None).cast("double") if quality is None else quality).alias("q"))
    q = text_quality(F.col("text"), F.col("size")) if quality is None else F.col("q")
    draw = F.when(F.col("id").isNull(), F.xxhash64(F.col("text"), F.lit(seed))).otherwise(F.xxhash64(F.col("id"), F.lit(seed)))
    unit = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / float(2**53)
    rows = rows.select("id", "source", "size", F.greatest(-F.log(unit) / q, F.lit(2.0**-60)).alias("key"))
    fine = F.floor(F.log2("key") * (RANGES * PARTS)).cast("int")
    rows = cut(rows.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / PARTS).cast("int")), "keys")
    parts = rows.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("words"))
    ranges = parts.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    known = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    known = (
        known.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    of_source = F.col("source").eqNullSafe(F.col("of"))

    def last_within(sums: DataFrame, at: str, start: Column) -> DataFrame:
        """By source: the last range ``at`` that begins within the budget, and the words before it."""
        before = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        low = sums.withColumn("low", start + F.coalesce(F.sum("words").over(before), F.lit(0)))
        return low.where(F.col("low") < F.col("left")).groupBy("of").agg(F.max(F.struct(at, "low")).alias("cut")).select("of", f"cut.{at}", "cut.low")

    wide = last_within(ranges.join(known.select("of", "left"), of_source), "coarse", F.lit(0))
    wide = wide.withColumnRenamed("of", "wide_of").withColumnRenamed("coarse", "wide").withColumnRenamed("low", "wide_low")
    inside = parts.join(known.select("of", "left"), of_source).join(wide, F.col("of").eqNullSafe(F.col("wide_of")) & (F.col("coarse") == F.col("wide")))
    narrow = last_within(inside, "fine", F.col("wide_low")).withColumnRenamed("of", "narrow_of").withColumnRenamed("fine", "last")
    # as a table its size is known, so it is broadcast only while it is small; as the
    # joined rows are written before the window, a large source can be split if it is not
    cuts = cut(known.join(narrow, F.col("of").eqNullSafe(F.col("narrow_of")), "left").drop("narrow_of"), "cuts")
    joined = cut(rows.join(cuts, of_source).withColumn("at", F.col("fine") - F.coalesce(F.col("last"), F.lit(-(2**30)))), "placed")
    whole = joined.where("at <> 0").withColumn("extra", (F.col("at") < 0).cast("long"))
    edge = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = (
        joined.where("at = 0")
        .withColumn("run", F.col("low") + F.coalesce(F.sum("size").over(edge), F.lit(0)))
        .withColumn("extra", (F.col("run") + F.col("size") / 2 <= F.col("left")).cast("long"))
        .drop("run")
    )
    out = whole.unionByName(end).withColumn("times", F.col("epochs") + F.col("extra"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row of ``docs`` as many times as ``mix`` takes it, with all columns.

    Rows that share an id are taken alike, as often as the most taken of them; a
    null id is an id. Null and wordless texts are not taken. Nulls in other
    columns, very long texts and columns of any name are carried along; an empty
    table gives an empty result.
    """
    id_col = options.get("id_col", "doc_id")
    taken = mix(docs, **options).where("taken > 0").groupBy(F.col(id_col).alias("taken_id")).agg(F.max("times").cast("int").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).join(taken, F.col("id").eqNullSafe(F.col("taken_id")))
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
