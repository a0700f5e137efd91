"""A navigable proximity graph over unit vectors: built by parts, stored as adjacency rows, searched best first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.operators.dense import PLACES
from lodestar.plans.lineage import cut

#: Vectors of a part, about; vectors that centres are fitted on at most (a bound of the fit alone), and rounds of it.
PART, FITTED, ROUNDS = 16384, 20_000, 8
#: Neighbours that are looked at and kept for each vector, and how much shorter a detour must be to replace an edge.
LOOKED, KEPT, ALPHA = 48, 16, 1.2
#: Queries that walk side by side.
LOT = 1024
#: Candidates whose least is known, and pairs that are multiplied at once.
BLOCK, PAIRS = 16, 1024
#: What single precision may hide of a score, and rows that are merged at once, about.
NEAR, FOUND = 1e-5, 1 << 19


@dataclass(frozen=True)
class ProximityIndex:
    """``rows`` (part, place, chunk_id, v, near): ``near`` has the places of a vector's neighbours in its part.

    ``centres`` has a row for each cluster of parts, ``parts`` how many each has.
    """

    rows: DataFrame
    centres: np.ndarray
    parts: list[int]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a fixed start."""
    c = x[np.random.default_rng(3).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.bincount(near, minlength=k)[:, None] > 0, _unit(total), c)
    return c


def neighbours(v: np.ndarray) -> np.ndarray:
    """[n, 2 * KEPT] places of each unit vector's neighbours, -1 where there are no more.

    Of the ``LOOKED`` nearest, nearest first, one is kept if no kept one is nearer to it by
    more than ``ALPHA``: so edges lead into different directions. Then each
    edge is also walked backwards, as far as there is room.
    """
    n = len(v)
    looked = min(LOOKED, n - 1)
    out = np.full((n, 2 * KEPT), -1, dtype=np.int32)
    if looked < 1:
        return out
    kept_of = []
    for a in range(0, n, 512):
        s = v[a : a + 512] @ v.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        near = np.argpartition(-s, looked - 1, axis=1)[:, :looked]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
        away = 1 - np.take_along_axis(s, near, axis=1)
        between = 1 - np.matmul(v[near], v[near].transpose(0, 2, 1))
        kept = np.zeros(near.shape, dtype=bool)
        count = np.zeros(len(near), dtype=np.int64)
        for j in range(looked):
            shadowed = (kept & (ALPHA * between[:, :, j] < away[:, j : j + 1])).any(axis=1)
            kept[:, j] = ~shadowed & (count < KEPT)
            count += kept[:, j]
        i, j = np.nonzero(kept)
        kept_of.append((a + i, near[i, j]))
    source, target = (np.concatenate(x) for x in zip(*kept_of, strict=True))
    # own edges first, then those that come back, each once
    pairs = np.concatenate((source * n + target, target * n + source))
    _, first = np.unique(pairs, return_index=True)
    pairs = pairs[np.sort(first)]
    source, target = pairs // n, pairs % n
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    nth = np.arange(len(source)) - np.searchsorted(source, source)
    room = nth < 2 * KEPT
    out[source[room], nth[room]] = target[room]
    return out


def _build(kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["chunk_id"].to_pylist()), kind="stable")
        table = table.take(pa.array(order))
        v = _matrix(table["v"])
        near = neighbours(v)
        n, d = v.shape
        lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))
        return pa.table({"part": table["part"], "place": pa.array(np.arange(n, dtype=np.int32)), "chunk_id": table["chunk_id"].cast(kind), "v": lists(v, d), "near": lists(near, near.shape[1])})

    return run


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            if b.num_rows:
                v = _unit(_matrix(b.column(1)))
                d = v.shape[1]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), flat, pa.array((v @ centres.T).argmax(axis=1))], ["chunk_id", "v", "cluster"])

    return run


def build(vectors: DataFrame, part: int = PART) -> ProximityIndex:
    """The graph of (chunk_id, v), by cosine. Vectors that are null, empty or zero take no part.

    Vectors are dealt to clusters around centres fitted on at most ``FITTED`` of them,
    one centre for each ``part`` vectors; a cluster that is larger is dealt
    by hash into parts of that size. A task builds the graph of one part with
    exact neighbours, so what it holds is bounded. Everything is indexed.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["chunk_id"].dataType
    rows = vectors.select("chunk_id", F.col("v").cast("array<float>").alias("v")).where(F.col("chunk_id").isNotNull() & F.exists("v", lambda x: x != 0))
    n = rows.count()
    name = kind.simpleString()
    if not n:
        return ProximityIndex(spark.createDataFrame([], f"part long, place int, chunk_id {name}, v array<float>, near array<int>"), np.zeros((0, 1), dtype=np.float32), [])
    share = min(1.0, FITTED / n)
    fit = rows.where(F.shiftrightunsigned(F.xxhash64("chunk_id"), 33) < int(share * 2**31)).orderBy(F.xxhash64("chunk_id")).limit(FITTED).select("v").toArrow()
    x = _unit(_matrix(fit["v"])) if fit.num_rows else _unit(_matrix(rows.limit(1).select("v").toArrow()["v"]))
    centres = _centres(x, max(1, min(len(x), -(-n // part))))
    shared = spark.sparkContext.broadcast(centres)
    placed = cut(rows.mapInArrow(_assign(shared), f"chunk_id {name}, v array<float>, cluster long"))
    size = np.zeros(len(centres), dtype=np.int64)
    for r in placed.groupBy("cluster").count().collect():  # a row a centre
        size[r["cluster"]] = r["count"]
    parts = np.maximum(1, np.ceil(size / (1.5 * part))).astype(int)
    first = np.cumsum(parts) - parts
    place = F.col("cluster").cast("int") + 1
    of = lambda a: F.element_at(F.array(*[F.lit(int(y)) for y in a]), place)
    dealt = placed.select((of(first) + F.pmod(F.xxhash64("chunk_id"), of(parts))).cast("long").alias("part"), "chunk_id", "v")
    made = dealt.groupBy("part").applyInArrow(_build(to_arrow_type(kind)), f"part long, place int, chunk_id {name}, v array<float>, near array<int>")
    return ProximityIndex(cut(made), centres, parts.tolist())


#: No entry of a list, and the bits of a score in one that are not its sign.
EMPTY, SIGN = np.uint64(2**64 - 1), np.uint32(1 << 31)


def _keys(score: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Entries of a list, smallest first: scores descending, then places; the lowest bit says that an entry was expanded."""
    bits = score.astype(np.float32).view(np.uint32)
    falling = np.where(bits & SIGN, bits, ~(bits | SIGN))
    return (falling.astype(np.uint64) << np.uint64(32)) | (place.astype(np.uint64) << np.uint64(1))


def _scores(keys: np.ndarray) -> np.ndarray:
    """Scores of entries; of ``EMPTY`` -inf."""
    falling = (keys >> np.uint64(32)).astype(np.uint32)
    score = np.where(falling & SIGN, falling, ~falling & ~SIGN).view(np.float32)
    return np.where(keys == EMPTY, np.float32(-np.inf), score)


def _places(keys: np.ndarray) -> np.ndarray:
    return np.where(keys == EMPTY, -1, ((keys >> np.uint64(1)) & np.uint64(2**31 - 1)).astype(np.int64))


def walks(v: np.ndarray, near: np.ndarray, q: np.ndarray, efs: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, scores, vectors looked at) of a best-first search of each query, best first, for each of rising ``efs``.

    All queries walk side by side. Each begins at the best of about a root of
    all vectors, spread evenly; a step expands the best candidate that wasn't, and a
    query ends with a list of ``ef`` candidates when the first ``ef`` all are. Until then a longer
    list takes the same steps, so one walk with the longest passes the ends of all.

    Lists are not kept in order: what was expanded is counted up to the next
    candidate, and candidates lie in blocks whose least are known. What the longest
    list has no room for goes when the blocks are full.
    """
    n, many, wide, width = len(v), len(q), efs[-1], near.shape[1]
    start = np.unique(np.linspace(0, n - 1, math.isqrt(n - 1) + 1).astype(np.int64))
    seen = np.zeros((many, n), dtype=bool)
    seen[:, start] = True
    seen = seen.ravel()
    looked = np.full(many, len(start), dtype=np.int64)
    # an edge that is not there leads back to where it begins
    near = np.where(near < 0, np.arange(n, dtype=near.dtype)[:, None], near)
    blocks = -(-(2 * wide + 8 * width) // BLOCK)
    first = np.sort(_keys(q @ v[start].T, np.broadcast_to(start, (many, len(start)))), axis=1)[:, :wide]
    ahead = np.full((many, blocks * BLOCK), EMPTY, dtype=np.uint64)
    ahead[:, : first.shape[1]] = first
    least, fill = ahead.reshape(many, blocks, BLOCK).min(axis=2), np.full(many, first.shape[1], dtype=np.int64)
    edge, floor = np.full(many, EMPTY, dtype=np.uint64), np.full(many, -np.inf, dtype=np.float32)
    done, steps = np.full((many, wide + BLOCK), EMPTY, dtype=np.uint64), 0
    ends = [np.full((many, ef), EMPTY, dtype=np.uint64) for ef in efs]
    counts = [np.zeros(many, dtype=np.int64) for _ in efs]
    rows, stage, lists = np.arange(many), np.zeros(many, dtype=np.int64), np.array(efs)
    every = rows
    x, y = (np.empty((PAIRS, v.shape[1]), dtype=np.float32) for _ in range(2))
    while len(rows):
        block = least.argmin(axis=1)
        best = least[every, block]
        # a list has ended if as many expanded ones as it holds come before the next, or there is no next
        over = every
        while len(over := over[(lists[stage[over]] <= steps) | (best[over] == EMPTY)]):
            over = over[(best[over] == EMPTY) | ((done[over, :steps] < best[over, None]).sum(axis=1) >= lists[stage[over]])]
            for s in np.unique(stage[over]):
                those = over[stage[over] == s]
                held = np.sort(done[those, :steps], axis=1)[:, : efs[s]]
                ends[s][rows[those], : held.shape[1]], counts[s][rows[those]] = held, looked[rows[those]]
            stage[over] += 1
            over = over[stage[over] < len(efs)]
        going = stage < len(efs)
        if not going.all():
            rows, stage, fill, edge, floor, block, best = (a[going] for a in (rows, stage, fill, edge, floor, block, best))
            ahead, least, done, every = ahead[going], least[going], done[going], np.arange(len(rows))
            if not len(rows):
                break
        if steps == done.shape[1]:
            done = np.concatenate((done, np.full_like(done, EMPTY)), axis=1)
        done[:, steps] = best
        steps += 1
        those = every * blocks + block
        held = ahead.reshape(-1, BLOCK).take(those, axis=0)
        np.putmask(held, held == best[:, None], EMPTY)
        ahead.reshape(-1, BLOCK)[those], least[every, block] = held, held.min(axis=1)
        around = near.take(_places(best), axis=0)
        spot = (rows * n)[:, None] + around
        new = np.flatnonzero(~seen.take(spot))
        seen[spot.ravel()[new]] = True
        i, to = new // width, around.ravel()[new]
        looked[rows] += np.bincount(i, minlength=len(rows))
        score, asks = np.empty(len(to), dtype=np.float32), rows[i]
        for a in range(0, len(to), PAIRS):
            b = min(a + PAIRS, len(to))
            np.take(v, to[a:b], axis=0, out=x[: b - a], mode="clip")
            np.take(q, asks[a:b], axis=0, out=y[: b - a], mode="clip")
            np.einsum("nd,nd->n", x[: b - a], y[: b - a], out=score[a:b])
        enters = np.flatnonzero(score >= floor.take(i))
        i, keys = i.take(enters), _keys(score.take(enters), to.take(enters))
        enters = keys < edge.take(i)
        i, keys = i[enters], keys[enters]
        many_of = np.bincount(i, minlength=len(rows))
        at = np.arange(len(i)) + (every * (blocks * BLOCK) + fill - np.cumsum(many_of) + many_of).take(i)
        ahead.reshape(-1)[at] = keys
        np.minimum.at(least.reshape(-1), at // BLOCK, keys)
        fill += many_of
        if int(fill.max()) + width > blocks * BLOCK:
            edge = np.partition(np.concatenate((done[:, :steps], ahead), axis=1), wide - 1, axis=1)[:, wide - 1]
            floor = _scores(edge)
            ahead = np.sort(ahead, axis=1)
            ahead[ahead > edge[:, None]] = EMPTY
            least, fill = ahead[:, ::BLOCK].copy(), (ahead != EMPTY).sum(axis=1)
    return [(_places(e), _scores(e), c) for e, c in zip(ends, counts, strict=True)]


def walk(v: np.ndarray, near: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``walks`` with one list."""
    return walks(v, near, q, (ef,))[0]


def _search(k: int, efs: tuple[int, ...], kinds: tuple[pa.DataType, pa.DataType]):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        qid, ids, scores, lists, visited, ends = [], [], [], [], [], [np.zeros(1, dtype=np.int64)]
        if index.num_rows and queries.num_rows:
            index = index.take(pa.array(np.argsort(index["place"].to_numpy())))
            v, own = _matrix(index["v"]), index["chunk_id"].combine_chunks()
            near = index["near"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            for at in range(0, queries.num_rows, LOT):
                part = queries.slice(at, LOT)
                q = _unit(_matrix(part["q"]))
                found = walks(v, near, q, efs)
                # what each list returns, once for all lists that do
                row, place, bit = [], [], []
                for e, (p, score, _) in enumerate(found):
                    edge = score[:, min(k, p.shape[1]) - 1] - NEAR
                    i, j = np.nonzero((p >= 0) & (score >= edge[:, None]))
                    p = p[i, j]
                    s = np.einsum("nd,nd->n", v[p].astype(np.float64), q[i].astype(np.float64))
                    order = np.lexsort((p, -np.round(s, PLACES), i))
                    i, p = i[order], p[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < min(k, efs[e])
                    row.append(i[keep])
                    place.append(p[keep])
                    bit.append(np.full(int(keep.sum()), 1 << e, dtype=np.int64))
                i, p, b = (np.concatenate(x) for x in (row, place, bit))
                pair, back = np.unique(i * len(v) + p, return_inverse=True)
                i, p = pair // len(v), pair % len(v)
                of = np.zeros(len(pair), dtype=np.int64)
                np.bitwise_or.at(of, back, b)
                qid.append(part["qid"].combine_chunks())
                ids.append(own.take(pa.array(p)))
                scores.append(np.einsum("nd,nd->n", v[p].astype(np.float64), q[i].astype(np.float64)))
                lists.append(of)
                visited.append(np.stack([x[2] for x in found], axis=1).ravel())
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(i, minlength=len(q))))
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        whole = lambda x, t: pa.concat_arrays(x).cast(t) if x else pa.array([], t)
        edges = pa.array(np.concatenate(ends), pa.int32())
        qids = whole(qid, kinds[0])
        each = pa.array(np.arange(len(qids) + 1) * len(efs), pa.int32())
        made = [pa.ListArray.from_arrays(*x) for x in ((edges, whole(ids, kinds[1])), (edges, flat(scores, pa.float64())), (edges, flat(lists, pa.int64())), (each, flat(visited, pa.int64())))]
        return pa.table([qids, *made], ["qid", "chunk_id", "score", "lists", "visited"])

    return run


def _merge(k: int, efs: tuple[int, ...], kinds: tuple[pa.DataType, pa.DataType]):
    """The best of some queries, of what their parts found."""

    def run(found: pa.Table) -> pa.Table:
        coded = found["qid"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        column = found["chunk_id"].combine_chunks()
        q = np.repeat(code, pc.list_value_length(column).to_numpy())
        ids, score, lists = column.flatten(), *(found[c].combine_chunks().flatten().to_numpy() for c in ("score", "lists"))
        sums = np.zeros((len(coded.dictionary), len(efs)), dtype=np.int64)
        np.add.at(sums, code, found["visited"].combine_chunks().flatten().to_numpy().reshape(-1, len(efs)))
        names = ids.unique()
        by_id = pc.index_in(ids, names.take(pc.sort_indices(names))).to_numpy()
        order = np.lexsort((by_id, -np.round(score, PLACES), q))
        out = []
        for e, ef in enumerate(efs):
            at = order[(lists[order] >> e) & 1 == 1]
            nth = np.arange(len(at)) - np.searchsorted(q[at], q[at])
            keep = nth < min(k, ef)
            out.append((np.full(int(keep.sum()), ef), at[keep], nth[keep] + 1, sums[q[at[keep]], e]))
        ef, at, rank, visited = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [pa.array(ef, pa.int32()), coded.dictionary.take(pa.array(q[at])).cast(kinds[0]), ids.take(pa.array(at)).cast(kinds[1]), pa.array(score[at]), pa.array(visited), pa.array(rank, pa.int32())]
        return pa.table(columns, ["ef", "qid", "chunk_id", "score", "visited", "rank"])

    return run


def _route(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first, parts = shared.value
        take = min(probes, len(centres))
        for b in batches:
            if b.num_rows and take:
                best = np.argsort(-(_unit(_matrix(b.column(1))) @ centres.T), axis=1, kind="stable")[:, :take]
                row = np.repeat(np.arange(len(best)), parts[best].sum(axis=1))
                part = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in best.ravel().tolist()])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(part.astype(np.int64))], ["qid", "q", "part"])

    return run


def search(index: ProximityIndex, queries: DataFrame, k: int, efs: tuple[int, ...] = (100,), probes: int = 4) -> DataFrame:
    """(ef, qid, chunk_id, score, rank, visited) of (qid, q): the ``k`` nearest by cosine that a walk with a list of ``ef`` finds.

    A query walks the parts of its ``probes`` nearest clusters; a part meets its queries in lots. With ``ef`` below
    ``k`` the list is shorter, as it holds no more. ``visited`` counts the vectors that a
    query was compared with. Larger ``ef`` and ``probes`` find more and cost more.
    Queries that are null, empty or zero have no rows.
    """
    spark = queries.sparkSession
    efs = tuple(sorted(set(efs)))
    asked = queries.select("qid", F.col("q").cast("array<float>").alias("q")).where(F.exists("q", lambda x: x != 0))
    kinds = asked.schema["qid"].dataType, index.rows.schema["chunk_id"].dataType
    parts = np.array(index.parts, dtype=np.int64)
    shared = spark.sparkContext.broadcast((index.centres, np.cumsum(parts) - parts, parts))
    # a part is sent to its lots, so their number follows the queries that a part meets, not all of them
    many, cores = asked.count(), spark.sparkContext.defaultParallelism
    met = many * min(1.0, probes / max(1, len(parts)))
    lots = max(1, math.ceil(met / (8 * LOT)), min(math.ceil(met / LOT), -(-2 * cores // max(1, int(parts.sum())))))
    sent = asked.mapInArrow(_route(shared, probes), f"qid {kinds[0].simpleString()}, q array<float>, part long").withColumn("lot", F.pmod(F.xxhash64("qid"), F.lit(lots)).cast("long"))
    held = index.rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    arrow = tuple(to_arrow_type(x) for x in kinds)
    qid, chunk_id = (x.simpleString() for x in kinds)
    # groups are few and long, so each gets a task that is not merged with others
    tasks = max(1, min(int(parts.sum()) * lots, 4096))
    held, sent = (x.repartition(tasks, "part", "lot") for x in (held, sent))
    found = held.groupBy("part", "lot").cogroup(sent.groupBy("part", "lot")).applyInArrow(_search(k, efs, arrow), f"qid {qid}, chunk_id array<{chunk_id}>, score array<double>, lists array<long>, visited array<long>")
    groups = max(cores, math.ceil(met * len(parts) * k / FOUND))
    dealt = found.groupBy(F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group"))
    return dealt.applyInArrow(_merge(k, efs, arrow), f"ef int, qid {qid}, chunk_id {chunk_id}, score double, visited long, rank int")


def sweep(found: DataFrame, exact: DataFrame, k: int, n: int) -> DataFrame:
    """(ef, recall, returned, visited_share) of ``search`` with several ``ef`` against the exact ``k``; rows returned and vectors looked at are means of a query."""
    best = exact.where(F.col("rank") <= k).select("qid", "chunk_id")
    asked = best.select("qid").distinct().count()
    hits = found.join(best, ["qid", "chunk_id"], "left_semi").groupBy("ef").agg(F.count(F.lit(1)).alias("hits"))
    total = best.count()
    per = found.groupBy("ef", "qid").agg(F.count(F.lit(1)).alias("rows"), F.max("visited").alias("visited")).groupBy("ef").agg(F.sum("rows").alias("rows"), F.sum("visited").alias("visited"))
    return per.join(hits, "ef", "left").select("ef", (F.coalesce("hits", F.lit(0)) / max(1, total)).alias("recall"), (F.col("rows") / max(1, asked)).alias("returned"), (F.col("visited") / max(1, asked * n)).alias("visited_share"))
