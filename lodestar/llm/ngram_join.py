"""N-gram Jaccard join: prefix filtering over rare-first shingles, and its components."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import arrow_rows, cut, drop, tree_sum, tune
from lodestar.llm.textkernels import Words, chunks, windows

#: Cells of the table that orders shingles by how often they occur: a fixed size, 2 bytes each when broadcast.
CELL_BITS = 22
#: Hash ranges in which the suffix filter compares two sets.
RANGES = 32
#: Tokens before a shared one that travel with it, so that a pair that has met by one of them doesn't meet again.
EARLIER = 8
#: Pairs of whole texts in a batch.
PAIR_ROWS = 64


def _tally(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                words = Words(data, offsets)
                _, h = windows(words.hashes(), words.row, words.rows, width)
                np.add.at(total, h >> np.uint64(64 - CELL_BITS), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    for x in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
    return pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_order(texts: DataFrame, width: int) -> np.ndarray:
    """Logarithmic rank of each cell's count over all texts, 14 bits; one array of 2**CELL_BITS cells.

    Any order that all texts share is right for prefix filtering; this one puts
    rare shingles first. Tasks count into a table of fixed size, and tables are
    added in a tree.
    """
    parts = texts.mapInArrow(_tally(width), "counts binary")
    rows = tree_sum(parts, _sum, "counts binary").collect()
    total = np.frombuffer(zlib.decompress(rows[0]["counts"]), dtype=np.uint32) if rows else np.zeros(1 << CELL_BITS, dtype=np.uint32)
    return np.minimum(np.log2(total + 1.0) * 512, (1 << 14) - 1).astype(np.uint16)


def ordered_sets(data: np.ndarray, offsets: np.ndarray, width: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of all rows, rare first within each row; their second hash; where each row begins and the end)."""
    words = Words(data, offsets)
    row, h = windows(words.hashes(), words.row, words.rows, width)
    _, g = windows(words.hashes(lane=1), words.row, words.rows, width)
    # a row's number takes 10 bits: a batch has at most 512 rows
    key = (row.astype(np.uint64) << np.uint64(54)) | (order[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
    at = np.argsort(key, kind="stable")
    row, h, g, key = row[at], h[at], g[at], key[at]
    same = key[1:] == key[:-1]
    if (same & ((h[1:] != h[:-1]) | (g[1:] != g[:-1]))).any():
        at = np.lexsort((g, h, key))
        row, h, g = row[at], h[at], g[at]
        same = (row[1:] == row[:-1]) & (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = ~same
    row, h, g = row[keep], h[keep], g[keep]
    return h, g, np.searchsorted(row, np.arange(words.rows + 1))


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a set of n of which any partner at num/den or more shares one."""
    return n - (num * n + den - 1) // den + 1 if n else 0


def _sets(width: int, num: int, den: int, order):
    names = ["id", "n", "cls", "tokens", "ranges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = order.value
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                h, g, edge = ordered_sets(data, offsets, width, rare)
                n = np.diff(edge)
                cls = [hashlib.blake2b(h[a:b].tobytes() + g[a:b].tobytes(), digest_size=16).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                signed = h.view(np.int64)
                size = np.array([prefix_length(int(k), num, den) for k in n], dtype=np.int64)
                take = np.repeat(edge[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                edges = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                tokens = pa.ListArray.from_arrays(edges, pa.array(signed[take]))
                row = np.repeat(np.arange(len(n)), n)
                cells = np.bincount(row * RANGES + ((h >> np.uint64(20)) % np.uint64(RANGES)).astype(np.int64), minlength=len(n) * RANGES)
                ranges = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * RANGES), pa.array(cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n.astype(np.int32)), pa.array(cls, pa.binary()), tokens, ranges], names)

    return run


def _close_lengths(n1: Column, n2: Column, num: int, den: int) -> Column:
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num)


def _least_overlap(n1: Column, n2: Column, num: int, den: int) -> Column:
    """ceil(num * (n1 + n2) / (num + den)): shared tokens of any pair at num/den or more."""
    return F.floor(((n1 + n2) * num + (num + den - 1)) / (num + den))


def _positional(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """If the token at these positions is the first shared, enough may follow. Later ones only fail sooner."""
    return F.least(n1 - p1, n2 - p2) >= _least_overlap(n1, n2, num, den)


def _size(packed: Column) -> Column:
    return F.shiftright(packed, 32)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF))


def _filters(x: Column, y: Column, num: int, den: int) -> Column:
    """Length and positional filter of two entries, each its set's size and its position packed."""
    return _close_lengths(_size(x), _size(y), num, den) & _positional(_size(x), _position(x), _size(y), _position(y), num, den)


def meet(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, pa, pb) of classes of different components, from entries (tok, rep, np, comp, earlier).

    Within a shingle the longer class looks into its own band of lengths and the
    next shorter one. A pair is left out where the tokens that travel with its
    entries (``earlier``, those just before) have one in common: it passes all
    filters there too, since its positions are smaller, so it has met there. What
    such a window misses only repeats a pair, never loses one.
    """
    banded = entries.withColumn("band", F.floor(F.log(_size(F.col("np")).cast("double")) / math.log(den / num)).cast("int"))
    x = banded.select("tok", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("rep").alias("x"), F.col("np").alias("nx"), F.col("comp").alias("cx"), F.col("earlier").alias("ex"))
    y = banded.select("tok", "band", F.col("rep").alias("y"), F.col("np").alias("ny"), F.col("comp").alias("cy"), F.col("earlier").alias("ey"))
    nx, ny = _size(F.col("nx")), _size(F.col("ny"))
    longer = (nx > ny) | ((nx == ny) & (F.col("x") < F.col("y")))
    # the costly test comes last
    pair = x.join(y, ["tok", "band"]).where(longer & (F.col("cx") != F.col("cy")) & _filters(F.col("nx"), F.col("ny"), num, den) & ~F.arrays_overlap("ex", "ey"))
    swap, px, py = F.col("x") < F.col("y"), _position(F.col("nx")), _position(F.col("ny"))
    return pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, px).otherwise(py).alias("pa"), F.when(swap, py).otherwise(px).alias("pb"))


def _suffix(ranges: Column, tokens: Column, position: Column) -> Column:
    """How many tokens behind ``position`` fall in each range: those of the whole set without the first ones."""
    first = F.transform(F.slice(tokens, F.lit(1), position + 1), lambda t: F.shiftrightunsigned(t, 20).bitwiseAND(F.lit(RANGES - 1)).cast("int"))
    return F.transform(ranges, lambda c, i: c - F.size(F.filter(first, lambda r: r == i)))


def _suffix_filter(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Drops pairs (a, b, pa, pb) whose suffixes behind their first shared token differ too much.

    What suffixes hold in each range of the hash bounds their difference from
    below. The first tokens share at most min(pa, pb) + 1, so suffixes must share the rest
    of the least overlap.
    """
    own = sets.select("rep", "n", "tokens", "ranges")
    a = own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("ranges").alias("ra"))
    b = own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("ranges").alias("rb"))
    joined = pairs.join(a, "a").join(b, "b")
    sa, sb = _suffix(F.col("ra"), F.col("ta"), F.col("pa")), _suffix(F.col("rb"), F.col("tb"), F.col("pb"))
    apart = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    needed = _least_overlap(F.col("na"), F.col("nb"), num, den) - F.least("pa", "pb") - 1
    room = F.col("na") - F.col("pa") + F.col("nb") - F.col("pb") - 2
    return joined.where(apart <= room - 2 * F.greatest(needed, F.lit(0))).select("a", "b")


def _hash_sets(texts: pa.Array, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both hashes of the distinct shingles of each text."""
    any_order, out = np.zeros(1 << CELL_BITS, dtype=np.uint16), []
    for _, data, offsets in chunks(texts):
        h, g, edge = ordered_sets(data, offsets, width, any_order)
        out += [(h[a:b], g[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def _linked(width: int, num: int, den: int):
    """The rows (a, b) of (a, b, ta, tb) whose whole sets reach num/den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for (ha, ga), (hb, gb) in zip(_hash_sets(batch.column(2), width), _hash_sets(batch.column(3), width), strict=True):
                # shingles count as shared if both of their hashes say so
                both = min(len(np.intersect1d(ha, hb)), len(np.intersect1d(ga, gb)))
                keep.append(both * den >= (len(ha) + len(hb) - both) * num)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach num/den, each tested once; only texts of documents in pairs move.

    Sets are made where a pair is tested: a text is several times smaller than the
    two hashes of each of its shingles, in shuffles and in tables.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    kind = docs.schema["id"].dataType.simpleString()
    texts = cut(docs.join(nodes, "id", "left_semi").select("id", "text").dropDuplicates(["id", "text"]), "texts")
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    # no aggregation follows the joins, so adaptive execution can split the pairs of a hub
    with arrow_rows(spark, PAIR_ROWS):
        links = cut(joined.mapInArrow(_linked(width, num, den), f"a {kind}, b {kind}"), "links")
    drop(texts)
    return links


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b): comp is the smallest node it can reach.

    Labels spread to neighbours and then jump to the label of their label, so the
    rounds are about the logarithm of the longest path; each round is a table.
    """
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").distinct(), "edges")
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = cut(spread.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), (F.least("comp", F.coalesce("far", "comp")) != F.col("old")).alias("moved")), "labels")
        drop(labels)
        labels = after
        if labels.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(edges)
    return labels.select("node", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id).

    A document's set holds its distinct shingles of ``width`` words, after folding
    A-Z; a shorter one is one shingle. Two link when ``den`` * intersection >=
    ``num`` * union, and ``component_id`` is the smallest id reachable by links.

    Documents of equal sets are one class, so copies never meet in pairs. Each
    class gives the rare-first prefix of its set to a join on shingles:

    1. A shingle's classes meet only the one in which it comes first (the most
       central); length and positional filters apply in the join, the suffix
       filter and the exact test once per pair. Components of these links follow.
    2. Shingles whose classes are all in one component are done: no pair of them
       can change the result. In the others, classes of different components
       meet within bands of length, under the same filters, at the first shingle
       that they share (``meet``): a pair leaves the join about once, however
       many shingles it shares.

    So no large group of near copies is expanded into all its pairs, while
    every link between two components is found. Sets are compared as two
    independent 64-bit hashes of shingles.

    Null, empty and wordless texts have 0 shingles, link with nothing and are
    their own component. Rows that share an id are one node of the graph, with a
    result row each. A null id takes no part and has a null component. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    order = spark.sparkContext.broadcast(frequency_order(own.select("text"), width))  # 2 bytes a cell
    schema = f"id {kind}, n int, cls binary, tokens array<long>, ranges array<int>"
    rows = cut(own.mapInArrow(_sets(width, num, den, order), schema), "prefixes")
    sets = cut(
        rows.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("cls")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("ranges").alias("ranges")), "classes",
    )
    whole, rows = rows, cut(rows.select("id", "n", "cls"), "members")
    drop(whole)
    entries = sets.select("rep", "n", F.posexplode("tokens").alias("pos", "tok"))
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    # dealt by shingle once: hubs are found where the entries lie, and both read the same shuffle
    entries = entries.select("tok", "rep", packed.alias("np")).repartition("tok")
    rank = F.shiftleft(F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)), 36) + F.shiftrightunsigned(F.xxhash64("rep"), 28)
    hubs = (
        entries.groupBy("tok").agg(F.min_by("rep", rank).alias("hub"), F.min_by("np", rank).alias("hub_np"), F.count(F.lit(1)).alias("c"))
        .where("c > 1").drop("c")
    )
    # entries whose shingle another class has in its prefix too
    shared = cut(entries.join(hubs, "tok"), "shared")
    p = lambda c: _position(F.col(c))
    first = F.col("rep") < F.col("hub")
    ordered = [F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), F.when(first, p("np")).otherwise(p("hub_np")).alias("pa"), F.when(first, p("hub_np")).otherwise(p("np")).alias("pb")]
    starred = shared.where((F.col("rep") != F.col("hub")) & _filters(F.col("np"), F.col("hub_np"), num, den))
    # of the tokens that two classes share in their prefixes, the first; positions rise together
    starred = starred.groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(p("np").alias("at"), "np", "hub_np")).alias("f"))
    # each class tests its likeliest hub now; the rest is left to the second step
    best = starred.groupBy("rep").agg(F.max_by(F.struct("hub", "f.np", "f.hub_np"), F.struct("c", F.xxhash64("hub"))).alias("x")).select("rep", "x.*")
    pairs = cut(_suffix_filter(best.select(*ordered).groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb")), sets, num, den), "pairs")
    links = _verify(pairs, own, width, num, den)
    labels = components(links)
    labelled = shared.select("tok", "rep", "np").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    labelled = cut(labelled, "labelled")
    drop(shared)
    open_toks = labelled.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
    # tables of their own, so that no side of the next joins is an aggregation: adaptive
    # execution can then split a shingle of many classes
    open_toks = cut(open_toks, "open")
    before = F.slice("tokens", F.greatest(p("np") - (EARLIER - 1), F.lit(1)).cast("int"), F.least(p("np"), F.lit(EARLIER)).cast("int"))
    rest = cut(labelled.join(open_toks, "tok").join(sets.select("rep", "tokens"), "rep").select("tok", "rep", "np", "comp", before.alias("earlier")), "open")
    drop(labelled, open_toks)
    # a table, so that what met is gone from disk before the pairs fetch their sets
    met = cut(meet(rest, num, den).groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb")), "met")
    drop(rest)
    pairs2 = cut(_suffix_filter(met.join(pairs, ["a", "b"], "left_anti"), sets, num, den), "pairs")
    drop(met)
    if pairs2.limit(1).count():
        more = _verify(pairs2, own, width, num, den)
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    reps = sets.select("cls", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("comp"))
    reps = cut(reps, "components")
    out = rows.join(reps, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("comp"))).otherwise(F.col("id")).alias("component_id"),
    )
    drop(sets, pairs, pairs2)
    return out


def deduplicate(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the one of the smallest id, with all columns.

    Null, empty and wordless texts link with nothing and stay, and so do rows
    without an id. Rows that repeat an id stay or go together. Very long texts are
    compared whole. An empty table gives an empty result. Columns may have any
    names.
    """
    stay = near_duplicates(docs, width, num, den, id_col, text_col)
    stay = stay.select(F.col(id_col).alias("stays"), "component_id").where(F.col("stays").isNull() | (F.col("stays") == F.col("component_id"))).select("stays").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")
