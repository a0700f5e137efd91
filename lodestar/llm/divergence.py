"""Source divergence audit: exact distances between the sources of a language, in tiles of groups by terms."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.runtime import arrow_rows, cut, drop, tune
from lodestar.llm.textkernels import NOT_LETTERS, Words, pieces

#: Terms of a block, about, and cells of a tile that are computed at once.
BLOCK_TERMS, TILE_CELLS = 2048, 1 << 20
#: Rows of counts that a task gathers before it hands them on.
MOST_COUNTS = 1 << 20
SCALE = 1_000_000_000


class _Counts:
    """Counts of (group, term) of a task: how often, and in how many documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, terms: pa.Array, group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((terms, group, term, n, docs))
        self.held += len(term)

    def merge(self) -> None:
        """One row of each group and term."""
        if len(self.parts) < 2:
            return
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first = np.concatenate(([0], np.cumsum([len(p[0]) for p in self.parts])))
        term = np.concatenate([code[a + p[2]] for a, p in zip(first, self.parts, strict=False)])
        key = np.concatenate([p[1] for p in self.parts]) * len(coded.dictionary) + term
        n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (3, 4))
        key, (n, docs) = _summed(key, n, docs)
        self.parts = [(coded.dictionary, key // max(1, len(coded.dictionary)), key % max(1, len(coded.dictionary)), n, docs)]
        self.held = len(key)

    def take(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        lang, source = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for terms, group, term, n, docs in self.parts:
            strings = terms.cast(pa.string())
            for a in range(0, len(term), 1 << 16):
                at = slice(a, a + (1 << 16))
                g = pa.array(group[at])
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), strings.take(pa.array(term[at])), pa.array(n[at]), pa.array(docs[at])], ["lang", "source", "term", "n", "docs"])
        self.parts, self.held = [], 0


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], [np.add.reduceat(v[order], first) if len(key) else v for v in values]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    long: list[tuple[pa.Array, np.ndarray]] = []  # the pieces so far of a text that comes in several
    for batch in batches:
        langs, sources = (pc.fill_null(batch.column(k), "").to_pylist() for k in (0, 1))
        groups = np.array([counts.group(*g) for g in zip(langs, sources, strict=True)], dtype=np.int64)
        for at, data, offsets, ended in pieces(batch.column(2), NOT_LETTERS):
            words = Words(data, offsets, sep=NOT_LETTERS)
            coded = words.strings().dictionary_encode()
            terms, size = coded.dictionary, max(1, len(coded.dictionary))
            code = coded.indices.to_numpy().astype(np.int64)
            # one row of each document and term, then of each group and term
            key, (n,) = _summed(words.row * size + code, np.ones(len(code), dtype=np.int64))
            if long or not ended:
                long.append((terms.take(pa.array(key % size)), n))
                if not ended:
                    continue
                coded = pa.concat_arrays([t for t, _ in long]).dictionary_encode()
                terms, size = coded.dictionary, max(1, len(coded.dictionary))
                key, (n,) = _summed(coded.indices.to_numpy().astype(np.int64), np.concatenate([n for _, n in long]))
                long = []
            key, (n, docs) = _summed(groups[at + key // size] * size + key % size, n, np.ones(len(key), dtype=np.int64))
            counts.add(terms, key // size, key % size, n, docs)
            if counts.held > MOST_COUNTS:
                counts.merge()
                if counts.held > MOST_COUNTS // 2:
                    yield from counts.take()
    yield from counts.take()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) without overflow: three digits at a time, for totals below 9e15."""
    rest = np.broadcast_to(count + 2, np.broadcast_shapes(count.shape, total.shape))
    out = np.zeros(rest.shape, dtype=np.int64)
    whole, rest = np.divmod(rest, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + whole * SCALE + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares."""
    d = p - q
    return d * d // (p + q)


def _tile(top: int):
    """The block of one language: partial sums of all pairs of its sources, and each source's heap of ``top`` terms."""

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        sources = groups["source"].to_pylist()
        order = sorted(range(len(sources)), key=lambda i: sources[i])
        sources = [sources[i] for i in order]
        place = {s: i for i, s in enumerate(sources)}
        lang, v = groups["lang"][0].as_py(), groups["v"][0].as_py()
        total = groups["n"].to_numpy()[order] + 2 * v
        all_total = np.array(groups["all_n"][0].as_py() + 2 * v)
        size = len(sources)
        pairs = np.zeros((size, size), dtype=np.int64)
        heaps: list[list[tuple[int, str]]] = [[] for _ in sources]
        if counts.num_rows:
            coded = counts["term"].combine_chunks().dictionary_encode()
            terms = coded.dictionary.to_pylist()
            term, n = coded.indices.to_numpy(), counts["n"].to_numpy()
            group = np.array([place[s] for s in counts["source"].to_pylist()], dtype=np.int64)
            by_term = np.argsort(term, kind="stable")
            term, n, group = term[by_term], n[by_term], group[by_term]
            width = max(1, TILE_CELLS // size)
            for a in range(0, len(terms), width):
                lo, hi = np.searchsorted(term, (a, a + width))
                tile = np.zeros((size, min(width, len(terms) - a)), dtype=np.int64)
                tile[group[lo:hi], term[lo:hi] - a] = n[lo:hi]
                p = shares(tile, total[:, None])
                rows = max(1, TILE_CELLS // tile.size)
                for i in range(0, size, rows):
                    pairs[i : i + rows] += apart(p[i : i + rows, None, :], p[None, :, :]).sum(axis=2)
                q = shares(tile.sum(axis=0), all_total)
                gain = apart(p, q[None, :])
                gain[(tile == 0) | (p <= q[None, :])] = -1
                for i in range(size):
                    own = np.flatnonzero(gain[i] >= 0)
                    if len(own) > top:  # ties at the edge stay until terms decide
                        edge = np.partition(gain[i][own], len(own) - top)[len(own) - top]
                        own = own[gain[i][own] >= edge]
                    found = heapq.nsmallest(top, ((-int(gain[i, t]), terms[a + t]) for t in own.tolist()))
                    heaps[i] = list(heapq.merge(heaps[i], found))[:top]
        one, two = np.triu_indices(size, 1)
        names = pa.array(sources, pa.string())
        held = [(i, x, t) for i, heap in enumerate(heaps) for x, t in heap]
        source = pa.concat_arrays([names.take(pa.array(one)), names.take(pa.array([i for i, _, _ in held], pa.int64()))])
        item = pa.concat_arrays([names.take(pa.array(two)), pa.array([t for _, _, t in held], pa.string())])
        value = pa.array(np.concatenate((pairs[one, two], np.array([-x for _, x, _ in held], dtype=np.int64))))
        part = pa.array(["pair"] * len(one) + ["term"] * len(held), pa.string())
        return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": source, "part": part, "item": item, "value": value})

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, in exact integers.

    Terms are runs of letters and of characters beyond ASCII, A-Z folded. A
    language keeps its V terms that at least ``least_docs`` of its documents hold.
    A group's share of a term is 1 + floor(1e9 * (count + 2) / (N + 2V)), and two
    shares p and q are floor((p - q)^2 / (p + q)) apart. Part ``pair``: to each
    other source of the language, the sum over all kept terms. Part ``term``: the
    ``top`` kept terms that the source holds more of than its language, by how far
    it is apart from that. Ranks begin at 1 in each group and part; ties go to the
    smaller item in UTF-8.

    Tasks count terms of the texts they read (in dictionaries of Arrow, so exactly)
    and hand on one row of each group and term; the sums are written once. Terms
    are dealt by hash into blocks of about ``BLOCK_TERMS``; a task holds one block
    of one language as a dense matrix of groups by terms, computes all pairs of
    groups by broadcasting, adds their matrices and keeps a heap for each group.
    Partial pair matrices are summed by Spark, heaps are cut to ``top`` once more.
    A block's matrix is taken in strips of ``TILE_CELLS``, so many groups or terms
    cost time, not memory. No step holds a whole vocabulary.

    Null text, lang and source count as ''. Groups without kept terms have pairs
    (0, if V is 0) and no terms; a language of one source has no pairs. Long texts
    are counted in pieces; a repeated row is a document of its own. Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).alias("text"))
    parts = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # dealt by language and term, so that sums, document counts and the choice of terms need one shuffle
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = summed.withColumn("all_docs", F.sum("docs").over(of_term)).where(F.col("all_docs") >= least_docs)
    kept = cut(kept.withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")).select("lang", "source", "term", "n", "first"), "counts")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("terms"))
    of_lang = Window.partitionBy("lang")
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = groups.select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("terms").over(of_lang), F.lit(0)).alias("v"), F.coalesce(F.sum("n").over(of_lang), F.lit(0)).alias("all_n"),
    )
    groups = cut(groups, "groups")
    terms = kept.agg(F.sum("first")).collect()[0][0] or 0
    blocks = max(8, -(-terms // BLOCK_TERMS))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("long").alias("block"), "source", "term", "n")
    asked = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    with arrow_rows(spark, 10_000):
        tiles = cut(
            dealt.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(_tile(top), "lang string, source string, part string, item string, value long"), "tiles",
        )
    drop(kept, groups)
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("i")), F.struct(F.col("item").alias("s"), F.col("source").alias("i")))
    pairs = pairs.select("lang", F.explode(both).alias("x"), "part", "value").select("lang", F.col("x.s").alias("source"), "part", F.col("x.i").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms_out = tiles.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms_out)
