"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.runtime import cut, take_by_hash, tune

#: Centroids of each half: a share of the square root of the vectors, within these bounds; the index has their square of cells.
LEAST_CENTROIDS, MOST_CENTROIDS, CELL_ROWS = 96, 1024, 12
#: Vectors that the centroids are fitted on, at most, by a hash of their id: a documented bound of the fit alone.
MAX_FITTED = 20_000
ROUNDS = 12
#: Share of all vectors that a query's cells hold at least, up to FULL vectors; beyond, the share falls as this power of them.
SHARE, FULL, FALL = 0.5, 512, 0.06
#: Groups of the index, as long as one has vectors within these bounds; and queries that meet it at once, about.
GROUPS, LEAST_GROUP, MOST_GROUP, GROUP_QUERIES = 24, 400, 20_000, 100_000


def centroids_for(n: int) -> int:
    """Centroids of each half for ``n`` vectors: about ``CELL_ROWS`` vectors a cell."""
    return max(LEAST_CENTROIDS, min(MOST_CENTROIDS, math.ceil(math.sqrt(n / CELL_ROWS))))


def budget(n: int, share: float, least: int) -> int:
    """Vectors that a query's cells hold at least, of ``n``: a share that falls with their number; 1 is all."""
    return int(max(least, n if share >= 1 else share * n * (FULL / max(n, FULL)) ** FALL))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def cells_of(x: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    half = centres[0].shape[1]
    a, b = (((y @ c.T) - 0.5 * (c * c).sum(1)).argmax(1) for y, c in zip((x[:, :half], x[:, half:]), centres, strict=True))
    return a * len(centres[1]) + b


def nearest_cells(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i, j) in order of left[i] + right[j], the smaller first, until they hold ``wanted`` vectors.

    The multi-sequence walk: of two sorted lists, a heap holds the pairs whose
    neighbours before them in either list have been taken.
    """
    i_order, j_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[i_order].tolist(), right[j_order].tolist()
    i_order, j_order, n = i_order.tolist(), j_order.tolist(), len(b)
    heap, taken, out, held = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = i_order[i] * n + j_order[j]
        taken[i] = j + 1
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < n and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and taken[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added in one order whatever the batch."""
    return np.add.reduce(x.astype(np.float64) * y.astype(np.float64), axis=1)


def _assigner(model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = model.value
        for batch in batches:
            x = matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(x, centres).astype(np.int32))], ["id", "v", "cell"])

    return run


def grouped(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of the cells of each left centroid.

    Centroids in turn share a group of about ``rows`` vectors; one with more has groups of its own.
    """
    first, many = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    at = held = 0
    for i, c in enumerate(counts.tolist()):
        if held and held + c > rows:
            at, held = at + 1, 0
        first[i] = at
        if c > rows:
            many[i] = -(-c // rows)
            at += int(many[i])
        else:
            held += c
    return first, many


def _router(model, dim: int, wanted: int):
    """Queries to the groups of the index that hold their cells, once each, with those cells as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (left, right), counts, first, many = model.value
        half, width = left.shape[1], len(right)
        lefts = {g: np.flatnonzero(first == g) for g in np.unique(first).tolist()}
        for batch in batches:
            x = matrix(batch.column(1), dim).astype(np.float64)
            # squared distances to the centroids, less what is the same for all
            a, b = (((c * c).sum(1) - 2.0 * (y @ c.T)) for y, c in ((x[:, :half], left), (x[:, half:], right)))
            rows, group, bits = [], [], []
            for q in range(len(x)):
                visited = np.zeros(len(left) * width, dtype=bool)
                visited[nearest_cells(a[q], b[q], counts, wanted)] = True
                visited = visited.reshape(len(left), width)
                for g, own in lefts.items():
                    some = visited[own]
                    if some.any():
                        packed = np.packbits(some).tobytes()
                        for k in range(int(many[own[0]])):
                            rows.append(q)
                            group.append(g + k)
                            bits.append(packed)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(group, pa.int64()), pa.array(bits, pa.binary())], ["id", "v", "group", "bits"],
            )

    return run


def visited_products(q: np.ndarray, v: np.ndarray, edge: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, int]:
    """(products, how many were computed): of each query with the vectors of the cells that it visits, -inf elsewhere.

    Vectors lie sorted by cell, from ``edge[c]`` to ``edge[c + 1]``; ``visits`` has the cells of each query.
    """
    s = np.full((len(q), len(v)), -np.inf)
    made = 0
    for c in np.flatnonzero((np.diff(edge) > 0) & visits.any(axis=0)).tolist():
        rows, a, b = np.flatnonzero(visits[:, c]), edge[c], edge[c + 1]
        s[rows, a:b] = q[rows] @ v[a:b].T
        made += len(rows) * (b - a)
    return s, made


def _meet(dim: int, k: int):
    """The best ``k`` of a group's vectors for each of its queries, of the cells that it visits."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.take(pa.array(np.argsort(vectors["place"].to_numpy(), kind="stable")))
            vid, qid = vectors["id"].to_numpy(), queries["id"].to_numpy()
            v32, q32 = matrix(vectors["v"], dim), matrix(queries["v"], dim)
            v, bits = v32.astype(np.float64), queries["bits"].to_pylist()
            cells = 8 * len(bits[0])
            edge = np.searchsorted(vectors["place"].to_numpy(), np.arange(cells + 1))
            step = max(64, (1 << 21) // len(v))
            for at in range(0, len(qid), step):
                q = q32[at : at + step].astype(np.float64)
                visits = np.unpackbits(np.frombuffer(b"".join(bits[at : at + step]), dtype=np.uint8).reshape(len(q), -1), axis=1).astype(bool)
                s, _ = visited_products(q, v, edge, visits)
                s[qid[at : at + step, None] == vid[None, :]] = -np.inf
                edge_score = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                edge_score -= 1e-9 * np.maximum(1.0, np.where(np.isfinite(edge_score), np.abs(edge_score), 0.0))
                i, j = np.nonzero((s >= edge_score[:, None]) & np.isfinite(s))
                exact = exact_products(q32[at + i], v32[j])
                order = np.lexsort((vid[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, np.arange(len(q) + 1))
                keep = np.arange(len(i)) - first[i] < k
                out_q.append(qid[at + i[keep]])
                out_v.append(vid[j[keep]])
                out_s.append(exact[keep])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "vec_id": pa.array(join(out_v, np.int64), pa.int64()), "score": pa.array(join(out_s, np.float64), pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product among the other rows.

    Two halves of the vectors are quantised separately with centroids fitted on
    at most ``MAX_FITTED`` vectors; every vector is in one of the cells that the
    pairs of centroids make. A query visits cells in order of the summed squared
    distances to the two centroids until they hold ``budget`` vectors, and
    reranks what they hold, and nothing else, by the exact product. With ``share`` 1 the search is
    exhaustive.

    Cells lie in groups of ``LEAST_GROUP`` to ``MOST_GROUP`` vectors; a left centroid with more is split
    by a hash of the id. A query goes to a group once, with its cells there as
    bits. Only where there are more than ``GROUP_QUERIES`` queries does a group
    meet them in lots, a nested loop of blocks. Of equal vectors only the k + 1 of
    the smallest ids can be among the nearest, so only these enter the index: a
    common vector doesn't crowd a cell, and no result is lost.

    Vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components take no part. Rows with a null id take no part. Ids
    are taken as unique; of repeated rows one takes part. Ties go to the smaller
    id. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size(v).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], empty)
    dim = dims[0]["dim"]
    rows = rows.where(F.size(v) == dim)
    fitted = take_by_hash(rows.select("id", "v"), "id", MAX_FITTED).toArrow()
    x = matrix(fitted["v"], dim).astype(np.float64)
    half, centroids = max(1, dim // 2), centroids_for(dims[0]["n"])
    centres = [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)] if dim > 1 else [kmeans(x, centroids), np.zeros((1, 0))]
    width = len(centres[1])
    model = spark.sparkContext.broadcast(centres)
    element = rows.schema["v"].dataType.simpleString()
    # one row of an id, then the k + 1 smallest ids of equal vectors
    few = rows.groupBy("id").agg(F.min("v").alias("v"))
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    indexed = cut(few.select("id", "v").mapInArrow(_assigner(model, dim), f"id long, v {element}, cell int"), "cells")
    counts = np.zeros(len(centres[0]) * width, dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS**2 rows
        counts[r["cell"]] = r["count"]
    first, many = grouped(counts.reshape(-1, width).sum(1), min(MOST_GROUP, max(LEAST_GROUP, int(counts.sum()) // GROUPS)))
    # of each left centroid: its groups, and which of the centroids of its group it is
    nth = np.arange(len(first)) - np.searchsorted(first, first)
    routing = spark.sparkContext.broadcast((centres, counts.tolist(), first, many))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    wanted = budget(int(counts.sum()), share, k + 1)
    lots = max(1, -(-dims[0]["asked"] // GROUP_QUERIES))
    sent = asked.select("id", "v").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(
        _router(routing, dim, wanted), f"id long, v {element}, group long, bits binary"
    ).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)))
    left = F.floor(F.col("cell") / width).cast("int") + 1
    of = lambda values: F.element_at(F.array(*[F.lit(int(y)) for y in values]), left)
    held = indexed.select(
        (of(first) + F.pmod(F.xxhash64("id"), of(many))).cast("long").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"),
        "id", "v", (of(nth) * width + F.pmod(F.col("cell"), F.lit(width))).alias("place"),
    )
    key = ["group", "lot"]
    found = held.groupBy(key).cogroup(sent.groupBy(key)).applyInArrow(_meet(dim, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
