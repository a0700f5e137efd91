"""Exact and approximate nearest rows by inner product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import dot, unit
from lodestar.plans.lineage import cut

#: Queries of one lot and vectors of one block: a task multiplies one by the other.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192
#: Digits that scores are compared at.
PLACES = 9
#: Scores of a row that are first looked at by their largest.
GROUP = 64
#: Queries and vectors that are multiplied at once in single precision, and of how many a query needs the others before a block is multiplied in double.
ASKED, TILE, DOUBTFUL = 256, 4096, 256


@dataclass(frozen=True)
class Formula:
    """A score ``dense * product + sum(parts)``; a pair is a candidate if one of the parts with a weight is there."""

    dense: float
    parts: tuple[float, ...] = ()


def exact_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of every pair of (qid, q) and (chunk_id, v): for small tables."""
    return queries.crossJoin(vectors).select("qid", "chunk_id", dot(F.col("q"), F.col("v")).alias("score"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row, columns in order among equals; -inf is no candidate."""
    groups = score.shape[1] // GROUP
    if k <= groups:
        # the k-th largest of the groups' largest is no more than the k-th largest of all
        tops = score[:, : groups * GROUP].reshape(len(score), groups, GROUP).max(axis=2)
        if len(score) and (tops < np.inf).all():
            edge = np.partition(tops, groups - k, axis=1)[:, groups - k]
            edge = edge - 2 * 10.0**-PLACES - 4e-15 * np.abs(edge)
            i, j = np.nonzero(score >= edge[:, None])
            value = score[i, j]
            real = np.isfinite(value)
            i, j, value = i[real], j[real], value[real]
            at = np.lexsort((j, -np.round(value, PLACES), i))
            i, j = i[at], j[at]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            return i[keep], j[keep]
    order = -np.round(score, PLACES)
    edge = np.partition(order, min(k, order.shape[1]) - 1, axis=1)[:, [min(k, order.shape[1]) - 1]]
    i, j = np.nonzero((order <= edge) & np.isfinite(score))
    at = np.lexsort((j, order[i, j], i))
    i, j = i[at], j[at]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _blend(formulas: dict[str, Formula], k: int):
    """Each formula's best ``k`` of a block of chunks for a lot of queries."""
    width = len(next(iter(formulas.values())).parts)

    def run(vectors: pa.Table, others: pa.Table) -> pa.Table:
        asked = others.filter(pc.is_null(others["chunk_id"]))
        met = others.filter(pc.is_valid(others["chunk_id"]))
        qids = asked["qid"].combine_chunks()
        # chunks in order of their ids, with and without a vector
        ids = pa.chunked_array([*vectors["chunk_id"].chunks, *met["chunk_id"].chunks], vectors["chunk_id"].type).unique()
        ids = ids.take(pc.sort_indices(ids))
        has = np.zeros(len(ids), dtype=bool)
        place = pc.index_in(vectors["chunk_id"], ids).to_numpy()
        has[place] = True
        whole = None
        if vectors.num_rows:
            v = _matrix(vectors["v"])
            whole = np.zeros((len(ids), v.shape[1]))
            whole[place] = v
        q_of = pc.index_in(met["qid"], qids).combine_chunks()
        known = pc.is_valid(q_of).to_numpy(zero_copy_only=False)
        rows, columns = q_of.fill_null(0).to_numpy()[known], pc.index_in(met["chunk_id"], ids).to_numpy()[known]
        parts = [met[f"p{m}"].to_numpy()[known] for m in range(width)]  # null is NaN
        order = np.argsort(rows, kind="stable")
        rows, columns, parts = rows[order], columns[order], [p[order] for p in parts]
        names, out_q, out_c, out_s = [], [], [], []
        step = max(1, (1 << 22) // max(1, len(ids)))
        with_vector = pc.is_valid(asked["q"]).to_numpy()
        for at in range(0, len(qids), step):
            n = min(step, len(qids) - at)
            lo, hi = np.searchsorted(rows, [at, at + n])
            r, c = rows[lo:hi] - at, columns[lo:hi]
            product, there = np.zeros((n, len(ids))), np.zeros((n, len(ids)), dtype=bool)
            mine = np.flatnonzero(with_vector[at : at + n])
            if whole is not None and len(mine):
                product[mine] = _matrix(asked["q"].take(pa.array(at + mine))) @ whole.T
                there[mine] = has
            spread = []
            for p in parts:
                value, held = np.zeros((n, len(ids))), np.zeros((n, len(ids)), dtype=bool)
                x = p[lo:hi]
                ok = ~np.isnan(x)
                value[r[ok], c[ok]], held[r[ok], c[ok]] = x[ok], True
                spread.append((value, held))
            for name, f in formulas.items():
                score, candidate = np.zeros((n, len(ids))), np.zeros((n, len(ids)), dtype=bool)
                for weight, (value, held) in zip((f.dense, *f.parts), ((product, there), *spread), strict=True):
                    if weight is not None:
                        score += weight * value
                        candidate |= held
                score[~candidate] = -np.inf
                i, j = _best(score, k) if len(ids) else (np.zeros(0, dtype=int),) * 2
                names += [name] * len(i)
                out_q.append(at + i)
                out_c.append(j)
                out_s.append(score[i, j])
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        return pa.table({"formula": pa.array(names, pa.string()), "qid": qids.take(pa.array(flat(out_q, int))), "chunk_id": ids.take(pa.array(flat(out_c, int))), "score": pa.array(flat(out_s, float))})

    return run


def blend_topk(queries: DataFrame, vectors: DataFrame, formulas: dict[str, Formula], k: int, met: DataFrame | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """(formula, qid, chunk_id, score, rank): the ``k`` best chunks of every query by each formula, ties to the smaller id.

    ``queries`` (qid, q) and ``vectors`` (chunk_id, v) give the product; ``met``
    (qid, chunk_id, parts...) has the scores of pairs that meet in some other way,
    null where a part does not hold. A query may have a null q. A weight of None
    leaves a part out: it neither scores nor makes a candidate.

    Blocks of chunks meet lots of queries: a task multiplies one by the other, adds
    the parts of its pairs and keeps the k best of each query and formula. No
    other pair leaves a task, and all formulas come from one product. Ids keep
    their types.
    """
    # a task holds a block of all chunks, with and without a vector
    n, asked = max(vectors.count(), 0 if met is None else met.select("chunk_id").distinct().count()), queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // VECTOR_BLOCK), min(cores, -(-n // 256)))
    # a lot gets all vectors and a block all queries: with nothing else to hold, lots are larger and fewer
    lots = max(1, -(-asked // (QUERY_BLOCK if met is not None else 4 * QUERY_BLOCK)))
    block, lot = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)), F.pmod(F.xxhash64("qid"), F.lit(lots))
    width = len(parts)
    if any(len(f.parts) != width for f in formulas.values()):
        raise ValueError("a formula needs a weight for each part")
    ids, kinds = queries.schema["qid"].dataType, vectors.schema["chunk_id"].dataType
    by = ["block", "lot"]
    none = [F.lit(None).cast("double").alias(f"p{m}") for m in range(width)]
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    others = queries.select(upto(blocks).alias("block"), lot.alias("lot"), F.col("qid").cast(ids), F.lit(None).cast(kinds).alias("chunk_id"), F.col("q").cast("array<double>").alias("q"), *none)
    if met is not None:
        own = [F.col(c).cast("double").alias(f"p{m}") for m, c in enumerate(parts)]
        others = others.unionByName(met.select(block.alias("block"), lot.alias("lot"), F.col("qid").cast(ids), F.col("chunk_id").cast(kinds), F.lit(None).cast("array<double>").alias("q"), *own))
    held = vectors.select(block.alias("block"), upto(lots).alias("lot"), "chunk_id", "v")
    schema = f"formula string, qid {ids.simpleString()}, chunk_id {kinds.simpleString()}, score double"
    found = held.groupBy(*by).cogroup(others.groupBy(*by)).applyInArrow(_blend(formulas, k), schema)
    rank = F.row_number().over(Window.partitionBy("formula", "qid").orderBy(F.desc(F.round("score", PLACES)), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _doubtful(q: np.ndarray, v: np.ndarray, hidden: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of all products that may be among the ``k`` largest of a row, where single precision hides up to ``hidden`` of one; None if they are too many."""
    found, number, tops = [], 0, np.zeros((len(q), 0), dtype=np.float32)
    for at in range(0, len(v), TILE):
        score = q @ v[at : at + TILE].T
        groups = score.shape[1] // GROUP
        if groups:
            # the k-th largest of the groups' largest is no more than the k-th largest of all
            tops = np.concatenate((tops, score[:, : groups * GROUP].reshape(len(q), GROUP, groups).max(axis=1)), axis=1)
            tops = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k:]
        edge = tops.min(axis=1) - hidden
        flat = np.flatnonzero(score >= edge[:, None])
        number += len(flat)
        if number > DOUBTFUL * len(q):
            return None
        i, j = np.divmod(flat, score.shape[1])
        found.append((i, at + j, score[i, j]))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    may = score >= edge[i]
    return i[may], j[may]


def _nearest(k: int):
    """The best ``k`` of a block of vectors for a lot of queries: found in single precision where that leaves few in doubt, decided in double."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.filter(pc.is_valid(asked["q"]))
        ids = vectors["chunk_id"].combine_chunks().unique()
        ids = ids.take(pc.sort_indices(ids))
        rows, columns, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if len(ids) and asked.num_rows:
            v = _matrix(vectors["v"])
            whole = np.zeros((len(ids), v.shape[1]))
            whole[pc.index_in(vectors["chunk_id"], ids).to_numpy()] = v
            single, longest = whole.astype(np.float32), np.linalg.norm(whole, axis=1).max()
            step = ASKED if k <= min(len(ids), TILE) // GROUP else max(1, (1 << 22) // len(ids))
            for at in range(0, asked.num_rows, step):
                q = _matrix(asked["q"].slice(at, step))
                size, found = np.linalg.norm(q, axis=1), None
                if step == ASKED and longest < 1e15 and size.max() < 1e15:
                    hidden = 2 * (1.01 * 2.0**-24 * (q.shape[1] + 4) * size * longest + 10.0**-PLACES)
                    found = _doubtful(q.astype(np.float32), single, hidden, k)
                if found is None:
                    most = max(1, (1 << 22) // len(ids))
                    for a in range(0, len(q), most):
                        product = q[a : a + most] @ whole.T
                        i, j = _best(product, k)
                        rows.append(at + a + i)
                        columns.append(j)
                        scores.append(product[i, j])
                    continue
                i, j = found
                score = np.concatenate([np.einsum("nd,nd->n", q[i[a : a + TILE]], whole[j[a : a + TILE]]) for a in range(0, len(i), TILE)])
                order = np.lexsort((j, -np.round(score, PLACES), i))
                order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                rows.append(at + i[order])
                columns.append(j[order])
                scores.append(score[order])
        of, to = (pa.array(np.concatenate(x)) for x in (rows, columns))
        return pa.table({"qid": asked["qid"].combine_chunks().take(of), "chunk_id": ids.take(to), "score": pa.array(np.concatenate(scores))})

    return run


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, cell: str | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the ``k`` best of all rows, or of those of the same ``cell``, by inner product, ties to the smaller id.

    Blocks of vectors meet lots of queries: a task multiplies one by the other and
    keeps the k best of each query, no other pair leaves it. A query may have a null q.
    With ``cell``, a column of both that is not null, a query meets the vectors of
    its cell alone.
    """
    cells = [] if cell is None else [F.col(cell).alias("cell")]
    if cell is not None:
        queries, vectors = queries.where(F.col(cell).isNotNull()), vectors.where(F.col(cell).isNotNull())
    most = lambda df: df.count() if cell is None else df.groupBy(cell).count().agg(F.max("count")).first()[0] or 0
    n, asked = most(vectors), most(queries)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    # each block gets all queries, each lot all vectors: few and large ones move the least
    blocks = max(1, -(-n // (4 * VECTOR_BLOCK)), min(cores, -(-n // 256)))
    lots = max(1, -(-asked // (4 * QUERY_BLOCK)))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("long")
    held = vectors.select(part("chunk_id", blocks).alias("block"), upto(lots).alias("lot"), "chunk_id", "v", *cells)
    asks = queries.select(upto(blocks).alias("block"), part("qid", lots).alias("lot"), "qid", "q", *cells)
    by = ["block", "lot"] + ["cell"] * len(cells)
    if cell is None:
        # groups are few and long, so each gets a task that is not merged with others
        held, asks = (x.repartition(min(blocks * lots, 4096), *by) for x in (held, asks))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    found = held.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(_nearest(k), schema)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", PLACES)), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _buckets(x: np.ndarray, normals: np.ndarray, probes: int) -> np.ndarray:
    """The buckets [rows, tables, probes] of each row: its own, then those across the planes that it lies closest to."""
    planes = normals.shape[1]
    side = np.einsum("nd,tpd->ntp", x, normals)
    own = ((side > 0) << np.arange(planes)).sum(axis=2)
    if probes == 1:
        return own[:, :, None]
    flips = np.arange(1 << planes)
    cost = side**2 @ ((flips[:, None] >> np.arange(planes)) & 1).T.astype(np.float64)
    return own[:, :, None] ^ np.argsort(cost, axis=2, kind="stable")[:, :, :probes]


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different ids of each row."""
    order = np.lexsort((ids, -np.round(score, 9), row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, score = row[new], ids[new], score[new]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, planes: int = 8, tables: int = 4, seed: int = 5, probes: int = 2) -> DataFrame:
    """Approximate form of ``exact_topk``: rows that share a random-hyperplane bucket in any table, reranked.

    A query looks into ``probes`` buckets of every table. ``planes``, ``tables`` and ``probes`` are the
    knob between recall and work. Queries that find fewer than ``k`` rows that way are searched exactly.
    Blocks of queries meet the rows as in ``exact_topk``: a task multiplies the rows of a bucket with
    the queries that look into it.
    """
    spark = queries.sparkSession
    rng = np.random.default_rng(seed)
    first = vectors.select("v").limit(1).collect()
    dim = len(first[0]["v"]) if first else 1
    normals = rng.standard_normal((tables, planes, dim))
    probes = min(probes, 1 << planes)
    rows = queries.select(F.col("qid").cast("long").alias("qid"), "q")
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    met = None
    for number in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == number).toArrow()  # about one block
        qid = part["qid"].to_numpy()
        block = spark.sparkContext.broadcast((qid, np.array(part["q"].to_pylist(), dtype=np.float64).reshape(len(qid), dim)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            qid, q = block.value
            looks = _buckets(q, normals, probes)
            best = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
            for batch in batches:
                if not batch.num_rows or not len(qid):
                    continue
                own = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(np.float64)
                held = _buckets(v, normals, 1)[:, :, 0]
                for t in range(tables):
                    found = [best]
                    for bucket in np.unique(held[:, t]):
                        here, asks = np.flatnonzero(held[:, t] == bucket), np.flatnonzero((looks[:, t] == bucket).any(axis=1))
                        if not len(asks):
                            continue
                        # by id, so that of equal scores the first k are those of the smallest ids
                        here = here[np.argsort(own[here], kind="stable")]
                        score = q[asks] @ v[here].T
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] if len(here) > k else score.min(axis=1, keepdims=True)
                        i, j = np.nonzero(score >= least - 1e-8)
                        found.append(_first(asks[i], own[here[j]], score[i, j], k))
                    best = list(_first(*(np.concatenate(x) for x in zip(*found, strict=True)), k))
            yield pa.RecordBatch.from_arrays([pa.array(qid[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["qid", "chunk_id", "score"])

        some = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "v").mapInArrow(run, "qid long, chunk_id long, score double")
        met = some if met is None else met.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    found = cut(met.dropDuplicates(["qid", "chunk_id"]).withColumn("rank", rank).where(F.col("rank") <= k))
    short = rows.join(found.where(F.col("rank") == k).select("qid"), "qid", "left_anti")
    if not short.limit(1).count():
        return found
    return found.join(short.select("qid"), "qid", "left_anti").unionByName(exact_topk(short, vectors, k))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, recall, top1): share of the exact ``k`` that were found, and whether the first agrees."""
    a = found.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].alias("a"))
    b = exact.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].alias("b"))
    both = b.join(a, "qid", "left").withColumn("a", F.coalesce("a", F.array().cast(b.schema["b"].dataType)))
    return both.select("qid", (F.size(F.array_intersect("a", "b")) / F.lit(float(k))).alias("recall"), F.coalesce(F.get("a", F.lit(0)) == F.get("b", F.lit(0)), F.lit(False)).alias("top1"))


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("v", unit(F.col("v")))


def similarity_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, score), a < b: the similarity matrix of a small table."""
    x, y = vectors.select(F.col("chunk_id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("chunk_id").alias("b"), F.col("v").alias("vb"))
    return x.crossJoin(y).where("a < b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("score"))


def encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text", out: str = "v") -> DataFrame:
    """Adds vectors from an injected encoder, called once an Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in encoder(texts.tolist())])

    return rows.withColumn(out, run(F.col(text_col)))


def encode_missing(rows: DataFrame, cache: DataFrame, encoder, id_col: str = "chunk_id") -> DataFrame:
    """(id, v) of all rows: from ``cache`` where it has them, newly encoded where not."""
    have = cache.join(rows.select(id_col), id_col, "left_semi").select(id_col, "v")
    new = encode(rows.join(cache.select(id_col), id_col, "left_anti"), encoder).select(id_col, "v")
    return have.unionByName(new)
