"""Ranked lexical search: shards of doc_id-sorted compressed postings, merged document by document."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.runtime import arrow_rows, cut, drop, tune
from lodestar.llm.textkernels import NOT_ALNUM, Words, pieces

#: Bytes of text and documents of a shard, about; documents that a merge completes at once.
SHARD_BYTES, SHARD_DOCS, WINDOW = 16 << 20, 1 << 15, 1 << 13
#: Items that one task answers at once from a shard.
LOT_ITEMS = 4096
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard long, term string, n long, terms long, docs binary, counts binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value ends): seven bits a byte, low ones first, the high bit where more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    live, k = np.arange(len(v)), 0
    while len(live):
        more = size[live] > k + 1
        out[end[live] - size[live] + k] = (((v[live] >> np.uint64(7 * k)) & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8)
        live, k = live[more], k + 1
    return out, end


def unpack(data: np.ndarray) -> np.ndarray:
    """The values of ``pack``."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    shift = (np.arange(len(data)) - np.repeat(first, last - first + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first)


class _Shard:
    """Postings of some documents, gathered text by text."""

    def __init__(self, number: int):
        self.number, self.ids, self.parts, self.bytes = number, [], [], 0

    def add(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, sep=NOT_ALNUM)
        coded = words.strings().dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, n = np.unique(words.row * size + coded.indices.to_numpy(), return_counts=True)
        self.parts.append((coded.dictionary, key % size, first + key // size, n))
        self.bytes += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row of each term, and one without a term of the documents that have any."""
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode() if self.parts else None
        if coded is None or not len(coded.dictionary):
            return
        code, base = coded.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(p[0]) for p in self.parts)])
        term = np.concatenate([code[b + p[1]] for b, p in zip(base, self.parts, strict=False)])
        doc, n = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3))
        ids = np.array(self.ids, dtype=np.int64)
        length = np.bincount(doc, weights=n, minlength=len(ids)).astype(np.int64)
        own = np.flatnonzero(length > 0)
        own = own[np.argsort(ids[own], kind="stable")]
        place = np.zeros(len(ids), dtype=np.int64)
        place[own] = np.arange(len(own))
        # postings by term and place; those of a text that came in pieces are added
        key = term * len(own) + place[doc]
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[first], np.add.reduceat(n, first)
        term, doc = key // len(own), key % len(own)
        begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gap = np.diff(doc, prepend=0)
        gap[begin] = doc[begin]
        end = np.concatenate((begin[1:], [len(term)]))
        blobs = []
        for values in (gap, n):
            data, ends = pack(values)
            edges = np.concatenate(([0], ends[end - 1]))
            blobs.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]))
        terms = coded.dictionary.take(pa.array(term[begin])).cast(pa.string())
        total = np.add.reduceat(n, begin)
        names = ["shard", "term", "n", "terms", "docs", "counts"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int64()), pa.array([None], pa.string()), pa.array([len(own)], pa.int64()), pa.array([int(length.sum())], pa.int64()),
             pa.array([ids[own].tobytes()], pa.binary()), pa.array([length[own].tobytes()], pa.binary())], names,
        )
        for a in range(0, len(begin), 1 << 14):
            at = slice(a, a + (1 << 14))
            docs, counts = (b[at].cast(pa.binary()) for b in blobs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), self.number)), terms[at], pa.array((end - begin)[at]), pa.array(total[at]), docs, counts], names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    shard = _Shard(number)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        first = len(shard.ids)
        shard.ids += ids.tolist()
        for at, data, offsets, _ in pieces(batch.column(1), NOT_ALNUM):
            shard.add(first + at, data, offsets)
        if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
            yield from shard.rows()
            shard = _Shard(shard.number + 1)
    yield from shard.rows()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An inverted index in shards, written as a table: no text is moved.

    A task makes shards of the documents that it reads, of about ``SHARD_BYTES`` of
    text; in a shard, documents are numbered by their id. A row with a term has the
    number of its documents (``n``), its occurrences (``terms``), and as packed
    bytes the gaps between its documents' numbers and its occurrences in each
    (``docs``, ``counts``). A row without a term has the shard's documents with
    terms: how many, all their terms, and as 64-bit values their ids in order
    and their lengths. Rows with a null id and texts without terms are not indexed.
    """
    tune(docs.sparkSession)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(_index, INDEX), "postings")


def text_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1)))


def merge_lists(lists: list[tuple[np.ndarray, np.ndarray]], held: int, k: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The ``k`` best (score, -number) of documents 0 to ``held``, best first, of lists of (numbers in order, gains).

    A heap holds every list by its next document. All lists whose next document
    is near the smallest give what they hold of these ``window`` documents, so each
    document is complete before any later one begins; then those that beat the
    worst of the bounded heap of results enter it. Equal scores go to the earlier.
    """
    at = [0] * len(lists)
    heads = [(int(docs[0]), t) for t, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(heads)
    best: list[tuple[int, int]] = []
    while heads:
        low = heads[0][0]
        score = np.zeros(min(window, held - low), dtype=np.int64)
        while heads and heads[0][0] < low + window:
            _, t = heapq.heappop(heads)
            docs, gains = lists[t]
            to = int(np.searchsorted(docs, low + window))
            score[docs[at[t] : to] - low] += gains[at[t] : to]
            at[t] = to
            if to < len(docs):
                heapq.heappush(heads, (int(docs[to]), t))
        # a later document never wins at an equal score
        found = np.flatnonzero(score > (best[0][0] if len(best) == k else 0))
        if len(found) > k:
            edge = np.partition(score[found], len(found) - k)[len(found) - k]
            above = found[score[found] > edge]
            found = np.sort(np.concatenate((above, found[score[found] == edge][: k - len(above)])))
        for d in found.tolist():
            entry = (int(score[d]), -(low + d))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return sorted(best, reverse=True)


def _answer(k: int, all_docs: int, all_terms: int, kind: pa.DataType):
    def run(postings: pa.Table, shard: pa.Table) -> pa.Table:
        items, ids_out, scores = [], [], []
        if postings.num_rows and shard.num_rows:
            ids, n = (np.frombuffer(shard[c][0].as_py(), dtype=np.int64) for c in ("ids", "lengths"))
            if 90 * all_docs * int(n.max()) < 1 << 63:
                m = 10 + 90 * n * all_docs // all_terms
            else:
                m = np.array([10 + 90 * x * all_docs // all_terms for x in n.tolist()], dtype=np.int64)
            of_item: dict[object, list[int]] = {}
            lists = []
            for docs, counts, w, asked in zip(*(postings[c].to_pylist() for c in ("docs", "counts", "w", "items")), strict=True):
                where, tf = np.cumsum(unpack(np.frombuffer(docs, dtype=np.uint8))), unpack(np.frombuffer(counts, dtype=np.uint8))
                lists.append((where, w * (1_000_000_000 * tf // (1000 * tf + 8 * m[where]))))
                for i in asked:
                    of_item.setdefault(i, []).append(len(lists) - 1)
            for item, own in of_item.items():
                for score, number in merge_lists([lists[t] for t in own], len(ids), k):
                    items.append(item)
                    ids_out.append(int(ids[-number]))
                    scores.append(score)
        return pa.table({"item": pa.array(items, kind), "doc": pa.array(ids_out, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item, rank, doc, score): each item's ``k`` highest-scoring documents of ``build_index``.

    Terms, weights and scores are those of ``ranked``. Only postings of terms
    that items have are read on; they are dealt by shard, and where there are
    more than ``LOT_ITEMS`` items, by lots of items too. A task merges an item's
    postings document by document into a heap of ``k``; the heaps of all
    shards are cut once more. A posting's gain is computed once for all items.

    Items of the same id are one item with the terms of all; a null item id
    takes no part, an item without terms has no rows.
    """
    spark = index.sparkSession
    tune(spark)
    totals = index.where(F.col("term").isNull()).agg(F.sum("n"), F.sum("terms")).collect()[0]
    all_docs, all_terms = totals[0] or 0, totals[1] or 1
    own = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(text_terms(F.col(text_col))).alias("term")).distinct()
    lots = max(1, -(-own.select("item").distinct().count() // LOT_ITEMS))
    asked = own.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(lots)).alias("lot")).agg(F.collect_list("item").alias("items"))
    asked = cut(asked, "asked")
    met = cut(index.join(asked.select("term").distinct(), "term").select("shard", "term", "n", "docs", "counts"), "met")
    df = met.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2 * all_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = cut(df.select("term", weight.cast("long").alias("w")).where("w > 0"), "weights")
    postings = met.join(asked.join(weights, "term"), "term").select("shard", "lot", "docs", "counts", "w", "items")
    shards = index.where(F.col("term").isNull()).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"), F.col("docs").alias("ids"), F.col("counts").alias("lengths"))
    kind = own.schema["item"].dataType
    with arrow_rows(spark, 10_000):
        found = cut(
            postings.groupBy("shard", "lot").cogroup(shards.groupBy("shard", "lot")).applyInArrow(_answer(k, all_docs, all_terms, to_arrow_type(kind)), f"item {kind.simpleString()}, doc long, score long"), "found",
        )
    drop(asked, met, weights)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z folded. Of N
    documents with terms, with L terms in all, a term in df of them weighs
    floor(1000 ln((2N + 2) / (2df + 1))). A document of n terms has
    m = 10 + (90 n N) div L, and its score is the sum over an item's distinct terms
    of weight * ((1e9 tf) div (1000 tf + 8m)). Equal scores go by ascending doc_id.

    Null, empty and termless texts count nowhere; rows with a null id take no
    part; repeated ids are documents of their own. Very long texts are read in
    pieces. Extra columns are ignored, whatever their names. Empty tables give an
    empty result.
    """
    return search(build_index(docs, id_col, text_col), items, k, item_col, "text", id_col)
