"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ngram_join import components
from lodestar.llm.runtime import arrow_rows, cut, drop, tune
from lodestar.llm.textkernels import SPACES, Words, pieces

#: Primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bits of a half that the code covers: a Hamming code of 31 bits, radius 1. Its parity checks are the bits of the position, 1 to 31.
COVERED, CHECKS = 31, 5
#: Fingerprints at home at an anchor that one task holds.
MOST_HOME = 4096
#: Shingles whose bits are counted at once.
BLOCK = 1 << 17


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range of ``data``, all ranges at once, block by block."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    seed = np.uint64(seed)
    size = end - start
    h = np.full(len(size), seed + P5, dtype=np.uint64)
    at = start.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            live = np.arange(len(long))
            while len(live):
                here = at[long[live]]
                for k in range(4):
                    v[k][live] = _round(v[k][live], eight[here + 8 * k])
                at[long[live]] += 32
                live = live[end[long[live]] - at[long[live]] >= 32]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.uint64(0), x)) * P1 + P4
            h[long] = acc
        h += size.astype(np.uint64)
        live = np.flatnonzero(end - at >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), eight[at[live]]), 27) * P1 + P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        h[live] = _rotl(h[live] ^ ((eight[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[live] += 4
        live = np.flatnonzero(end > at)
        while len(live):
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            live = live[end[live] > at[live]]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words with one space behind each, where each begins, where each ends)."""
    size = words.end - words.start
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin[:-1], size) + nth] = words.low[np.repeat(words.start, size) + nth]
    return out, begin[:-1], begin[:-1] + size


def _shingles(words: Words, begin: np.ndarray, end: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of every ``width`` words of a row; with ``short``, a row of fewer words is one shingle."""
    m = max(0, len(words) - width + 1)
    full = np.flatnonzero(words.row[:m] == words.row[width - 1 :]) if m else np.zeros(0, dtype=np.int64)
    row, a, b = words.row[full], begin[full], end[full + width - 1]
    if short:
        per_row = words.per_row()
        few = np.flatnonzero((per_row > 0) & (per_row < width))
        if len(few):
            first = (np.cumsum(per_row) - per_row)[few]
            row, a, b = np.concatenate((row, few)), np.concatenate((a, begin[first])), np.concatenate((b, end[first + per_row[few] - 1]))
            order = np.argsort(row, kind="stable")
            row, a, b = row[order], a[order], b[order]
    return row, a, b


def _bits(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> np.ndarray:
    """How many hashes of each row set each of the 64 bits."""
    counts = np.zeros((rows, 64), dtype=np.int64)
    for a in range(0, len(row), BLOCK):
        r = row[a : a + BLOCK]
        h = xxh64(data, start[a : a + BLOCK], end[a : a + BLOCK])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        counts[r[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return counts


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            rest, counts, seen = None, 0, 0  # of a text that comes in pieces: its last words, and what is counted
            for at, data, offsets, ended in pieces(batch.column(1), SPACES):
                if rest is not None:
                    data = np.concatenate((rest, data))
                    offsets = np.array([0, len(data)])
                words = Words(data, offsets)
                joined, begin, end = _joined(words)
                row, a, b = _shingles(words, begin, end, width, short=ended and not seen)
                here, n = _bits(joined, row, a, b, words.rows), np.bincount(row, minlength=words.rows)
                if rest is not None or not ended:
                    counts, seen = counts + here, seen + int(n[0])
                    rest = joined[int(np.append(begin, len(joined))[max(0, len(words) - width + 1)]) :]
                    if not ended:
                        continue
                    here, n = counts, np.array([seen])
                    rest, counts, seen = None, 0, 0
                set_bits = (2 * here > n[:, None]).astype(np.uint8)
                out[at : at + len(n)] = np.packbits(set_bits, axis=1, bitorder="little").view("<i8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row: the SimHash of its shingles of ``width`` words, as a signed 64-bit number.

    Words are folded in A-Z; shingles count with repeats. A bit is set if it is in
    over half of the XXH64 hashes (seed 42). Fewer words are one shingle; null,
    empty and wordless texts have 0. Long texts are counted in pieces.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprints(width), f"id {own.schema['id'].dataType.simpleString()}, fp long")


def _to_codewords() -> list[list[int]]:
    """For each syndrome, what turns a word into the codewords within 2 of it; the nearest first.

    Position i of 1 to 31 has the parity checks of the bits of i. The word at
    distance 1 flips the position that the syndrome names; those at distance 2
    flip two positions whose numbers add to it without carry.
    """
    bit = lambda i: 1 << (i - 1)
    pairs = lambda s: [bit(i) | bit(i ^ s) for i in range(1, COVERED + 1) if i < i ^ s]
    return [[0]] + [[bit(s), *pairs(s)] for s in range(1, COVERED + 1)]


def anchors(fp: Column, half: int) -> Column:
    """The anchors of one half of a fingerprint within covering radius plus threshold, 1 + 1; the first is its home."""
    word = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << COVERED) - 1))
    syndrome = F.lit(0)
    for k in range(CHECKS):
        check = sum(1 << (i - 1) for i in range(1, COVERED + 1) if i >> k & 1)
        syndrome = syndrome + F.bit_count(word.bitwiseAND(F.lit(check))) % 2 * (1 << k)
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in _to_codewords()])
    return F.transform(F.element_at(flips, (syndrome + 1).cast("int")), lambda x: word.bitwiseXOR(x))


class _Home:
    """The fingerprints at home at an anchor, and which of them the links so far join."""

    def __init__(self, key: int, fps: np.ndarray):
        self.key, self.fps, self.label = key, fps, np.arange(len(fps))

    def meet(self, others: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between ``others`` and those at home that join all that are near: at most one a row, and one a merger."""
        step = max(1, (1 << 21) // len(self.fps))
        for at in range(0, len(others), step):
            x = others[at : at + step]
            differ = x[:, None] ^ self.fps[None, :]
            near = (np.bitwise_count(differ) <= distance) & (differ != 0)
            met = np.flatnonzero(near.any(axis=1))
            if not len(met):
                continue
            near, x = near[met], x[met]
            yield x, self.fps[near.argmax(axis=1)]
            low = np.where(near, self.label, len(self.fps)).min(axis=1)
            high = np.where(near, self.label, -1).max(axis=1)
            for i in np.flatnonzero(low != high).tolist():
                own = np.flatnonzero(near[i])
                labels, first = np.unique(self.label[own], return_index=True)
                if len(labels) > 1:
                    yield np.repeat(x[i], len(labels)), self.fps[own[first]]
                    self.label[np.isin(self.label, labels)] = labels[0]


def _compare(distance: int):
    """Rows (k, fp) sorted by k: an anchor is k / 2, and those at home there come first, with even k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: _Home | None = None
        for batch in batches:
            k, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            key, away = k >> 1, (k & 1).astype(bool)
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((edge, [len(k)])))
            at_home = np.add.reduceat((~away).astype(np.int64), edge)
            # anchors at which nothing can meet are passed over; the last may go on in the next batch
            open_ = (at_home > 0) & (size > 1)
            open_[-1] = at_home[-1] > 0
            if home is not None and key[0] == home.key:
                open_[0] = True
            found = []
            for s in np.flatnonzero(open_).tolist():
                a, b = int(edge[s]), int(edge[s] + size[s])
                own = fps[a : a + int(at_home[s])]
                if home is not None and home.key == key[a]:
                    if len(own):  # homes of an anchor are few, so the rest of them is met by those before
                        before, home = home.fps, _Home(home.key, np.concatenate((home.fps, own)))
                        found += home.meet(before, distance)
                else:
                    home = _Home(int(key[a]), own)
                found += home.meet(fps[a:b], distance)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[side] for f in found]).view(np.int64)) for side in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, fingerprint, component_id).

    ``fingerprint`` is ``fingerprints`` in 16 hexadecimal digits; two rows link at
    ``distance`` or fewer differing bits (at most 3), and ``component_id`` is the
    smallest id reachable by links.

    Of two fingerprints that differ in at most 3 bits, one half differs in at most
    one. Each half's anchors are the codewords of a Hamming code, a covering code of
    radius 1. A fingerprint is at home at its nearest anchor and is sent to
    all within radius plus threshold, 1 + 1: 15.5 of each half's 2**26 on average. So the two
    meet at the home of either, and are compared there by all 64 bits. (Anchors of whole
    fingerprints at radius plus 3 would be thousands for a code of this fineness.)

    Equal fingerprints are one node, so copies never meet in pairs. Anchors lie
    sorted in partitions; a task holds those at home at one anchor, at most about
    ``MOST_HOME`` (an anchor with more is split, and all others are sent to each
    part), and streams the others past them. It emits links that join all that
    are near: at most one for each row that passes and one for each merger, never
    all pairs of a group.

    Null, empty and wordless texts have fingerprint 0 and link like any other.
    Rows that share an id are one node only if their texts agree: ids take the
    component of their own text. A null id has a fingerprint, takes no part in
    links and has a null component. Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with anchors within 2 serve distances up to 3")
    spark = docs.sparkSession
    rows = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = cut(rows.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    place = lambda half, anchor: F.lit(half << COVERED).cast("long").bitwiseOR(anchor)
    homes = nodes.select(F.explode(F.array(*[place(h, F.element_at(anchors(F.col("fp"), h), 1)) for h in (0, 1)])).alias("place"))
    crowded = homes.groupBy("place").count().where(F.col("count") > MOST_HOME)
    crowded = cut(crowded.select("place", F.ceil(F.col("count") / MOST_HOME).cast("long").alias("parts")), "crowded")
    sent = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), anchors(F.col("fp"), h).alias("at")) for h in (0, 1)])).alias("x"))
    sent = sent.select("fp", "x.half", F.posexplode("x.at").alias("nth", "anchor"))
    sent = sent.select("fp", "nth", F.shiftleft(F.col("half").cast("long"), COVERED).bitwiseOR(F.col("anchor")).alias("place"))
    sent = sent.join(crowded, "place", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    at_home = lambda p: F.when((F.col("nth") == 0) & (p == own), 0).otherwise(1)
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.shiftleft(F.col("place"), 31) + F.shiftleft(p, 1) + at_home(p))
    sent = sent.select(F.explode(keys).alias("k"), "fp").repartition(F.shiftright("k", 1)).sortWithinPartitions("k", "fp")
    with arrow_rows(spark, 20_000):
        links = cut(sent.mapInArrow(_compare(distance), "a long, b long"), "links")
    labels = components(links)
    comps = labels.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = cut(comps.groupBy("comp").agg(F.min("rep").alias("component")), "least")
    reps = labels.join(least, "comp").select(F.col("node").alias("fp"), "component")
    reps = nodes.join(reps, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    reps = cut(reps, "components")
    out = rows.join(reps, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
    drop(nodes, crowded, links, least)
    return out
