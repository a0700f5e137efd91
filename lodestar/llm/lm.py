"""Language-model scores by a hierarchical Pitman-Yor model over words.

Every word is a context with a restaurant of its own, whose dishes are the words
that follow it. All contexts share one parent, the restaurant of words, and its
base is a spelling model: restaurants of byte contexts down to a uniform base.
Seating is sampled by Gibbs sweeps (``seating``), and the predictive
probabilities of the sweeps after burn-in are averaged.

Events are the V words (the end of a text is one) that training saw, and one
event for all others. The spelling model gives a known word w the base
probability H(w), and the rest of its mass, 1 - sum of H over known words, is
that of the unknown, so in every context probabilities sum to 1.

Where the work is done: a task reads some texts once and deals their word pairs
to *parts* by context; a part holds whole contexts, or, of a context with more
tokens than a part, the following words of one hash class. The restaurant of
words lies in *buckets* of words. In each sweep parts send the tables they have
of each word to the buckets, and buckets send the state of those words back.
Both are arrays in compressed blobs, so no row is made for a token or a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import arrow_rows, cut, drop, drop_kind, sweep, tune
from lodestar.llm.seating import CONTEXT, STRENGTH, Seats, Spelling, discount_of, events, spell
from lodestar.llm.textkernels import Words, chunks, crc_remainder, mix, range_hashes

FOLDS, HELD = 7, 2
#: Words with the largest counts that are numbered in a broadcast table: a bound on the table, not on what is scored.
FREQUENT = 1 << 19
#: Tokens of a part and words of a bucket, about.
PART_TOKENS, BUCKET_WORDS, LEAST_PARTS = 2_000_000, 100_000, 16
#: Tokens of a lot: what a task collects before it deals it to the parts.
LOT_TOKENS, LOT_ROWS = 1_500_000, 1 << 19
#: Shares of the parts that are scored one after the other.
SLICES = 4
#: Words of a batch where words are rows.
WORD_ROWS = 50_000
BURN_IN, SAMPLES = 1, 3
SPELL_BURN_IN, SPELL_SAMPLES = 2, 4
_RARE = np.uint64(1 << 63)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---- arrays in blobs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: their bytes by significance, compressed."""
    parts = [np.array([len(arrays)], dtype="<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        squeezed = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        parts += [np.array([len(a), len(squeezed)], dtype="<i8").tobytes(), a.dtype.str.encode().ljust(8), squeezed]
    return b"".join(parts)


def steps_of(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which are small where values rise: they compress better. ``sums_of`` takes them back."""
    return np.diff(a, prepend=a.dtype.type(0))


def sums_of(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def unpack(blob) -> list[np.ndarray]:
    blob = memoryview(blob.as_buffer() if hasattr(blob, "as_buffer") else blob)
    n, at, out = int(np.frombuffer(blob[:8], "<i8")[0]), 8, []
    for _ in range(n):
        size, squeezed = (int(x) for x in np.frombuffer(blob[at : at + 16], "<i8"))
        kind = np.dtype(bytes(blob[at + 16 : at + 24]).decode().strip())
        at += 24
        if size:
            planes = pa.decompress(blob[at : at + squeezed], size * kind.itemsize, codec="zstd")
            out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, size).T).view(kind).ravel())
        else:
            out.append(np.zeros(0, dtype=kind))
        at += squeezed
    return out


# ---- counting words


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as a string array."""
    size = end - start
    to = np.cumsum(size)
    take = np.repeat(start - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], to)).astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times) of training rows; the end of a text is the word ''."""
    for batch in batches:
        keep = np.flatnonzero(crc_remainder(batch.column(0).to_pylist(), FOLDS) != HELD)
        if not len(keep):
            continue
        for _, data, offsets in chunks(batch.column(1).take(pa.array(keep)), 1 << 21):
            words = Words(data, offsets)
            _, where, times = np.unique(words.hashes(), return_index=True, return_counts=True)
            found = _gather(words.low, words.start[where], words.end[where])
            yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(times)], ["word", "times"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([len(keep)], pa.int64())], ["word", "times"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times, h): with the hash that texts are read with."""
    for batch in batches:
        for at, data, offsets in chunks(batch.column(0), 1 << 22):
            h, n = range_hashes(data, offsets[:-1], offsets[1:]), len(offsets) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(h.view(np.int64))], ["word", "times", "h"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            unique, times = np.unique(events(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(times)], ["gram", "times"])


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words whose counts are above the least bound that at most ``most`` words pass: found without a sort."""
    size = F.floor(F.log2("times") * 16)
    classes = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # 16 rows for each doubling of the count
    held, least = 0, None
    for r in sorted(classes, key=lambda r: -r["size"]):
        held += r["n"]
        if held > most:
            break
        least = r["size"]
    return words.where(F.lit(False) if least is None else size >= least)


def word_ids(h: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Ids of word hashes: the number of a frequent word (``keys`` ascend), else the hash with its top bit set."""
    out = h | _RARE
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        out[hit] = numbers[at[hit]]
    return out


# ---- dealing texts to parts


class Dealer:
    """Deals the word pairs of texts to parts: by context, and by class of the next word where a context is hot."""

    def __init__(self, keys, numbers, base, hot_ids, hot_splits, parts: int):
        self.keys, self.numbers, self.base, self.parts = keys, numbers, base, np.uint64(parts)
        self.hot_ids, self.hot_splits = hot_ids, hot_splits
        self.edge = range_hashes(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))

    def lot(self, h: np.ndarray, counts: np.ndarray, train: np.ndarray):
        """Of a lot with word hashes ``h`` of rows of ``counts`` words: (known tokens, base) of each row
        from numbered words, and an iterator of (part, pairs, entries, number of entries)."""
        rows = len(counts)
        unique, inverse = np.unique(np.concatenate((h, self.edge)), return_inverse=True)
        ids, edge = word_ids(unique, self.keys, self.numbers), inverse[-1]
        row = np.repeat(np.arange(rows), counts)
        spot = np.arange(len(h)) + row  # every row has one more event than words
        context = np.full(len(h) + rows, edge)
        word = np.full(len(h) + rows, edge)
        word[spot], context[spot + 1] = inverse[:-1], inverse[:-1]
        row = np.repeat(np.arange(rows), counts + 1)
        context[np.cumsum(counts + 1) - counts - 1] = edge
        numbered = ids < _RARE
        value = np.zeros(len(ids))
        value[numbered] = self.base[ids[numbered].astype(np.int64)]
        known, base = (np.bincount(row, weights=x[word], minlength=rows) for x in (numbered, value))
        return known, base, self._blobs(ids, context, word, row, train)

    def _blobs(self, ids, context, word, row, train):
        # contexts that are hot become several
        at = np.minimum(np.searchsorted(self.hot_ids, ids), max(0, len(self.hot_ids) - 1))
        hot = self.hot_ids[at] == ids if len(self.hot_ids) else np.zeros(len(ids), dtype=bool)
        splits = np.where(hot, self.hot_splits[at], 1) if len(self.hot_ids) else np.ones(len(ids), dtype=np.int64)
        first = np.cumsum(splits) - splits
        full_id = np.repeat(ids, splits)
        part = mix(full_id + (np.arange(len(full_id)) - np.repeat(first, splits)).astype(np.uint64) * _GOLD) % self.parts
        place = np.lexsort((full_id, part))
        rank = np.empty(len(place), dtype=np.uint64)
        rank[place] = np.arange(len(place), dtype=np.uint64)
        split = first[context]
        where = np.flatnonzero(hot[context])
        split[where] += (mix(ids[word[where]]) % splits[context[where]].astype(np.uint64)).astype(np.int64)
        order = np.argsort(ids)
        word_rank = np.empty(len(ids), dtype=np.uint64)
        word_rank[order] = np.arange(len(ids), dtype=np.uint64)
        # widths follow the lot: a text of very many different words is a lot of its own, so its rows are few
        row_bits, word_bits = (np.uint64(int(size).bit_length()) for size in (train.size, len(ids)))
        if int(row_bits + word_bits) + len(full_id).bit_length() > 64:
            raise OverflowError(f"a lot of {train.size} rows and {len(ids)} different words")
        key = (rank[split] << (row_bits + word_bits)) | (word_rank[word] << row_bits) | row.astype(np.uint64)
        key.sort()
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(begin, len(key)))
        key = key[begin]
        row = (key & np.uint64((1 << int(row_bits)) - 1)).astype(np.int64)
        pair = key >> row_bits
        begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        learned = np.add.reduceat(times * train[row], begin)
        entries = np.diff(np.append(begin, len(pair)))
        pair = pair[begin]
        of = place[(pair >> word_bits).astype(np.int64)]
        v, w = full_id[of], ids[order[(pair & np.uint64((1 << int(word_bits)) - 1)).astype(np.int64)]]
        owner = part[of].astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        entry = np.concatenate((begin, [len(row)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x, y = entry[a], entry[b]
            yield (int(owner[a]), pack(v[a:b], w[a:b], learned[a:b].astype(np.int32)),
                   pack(entries[a:b].astype(np.int32), row[x:y].astype(np.int32), times[x:y].astype(np.int32)), int(y - x))


_DEALT = ["lot", "row", "id", "held_out", "n_tokens", "n_known", "base", "part", "pairs", "entries", "n"]


def _deal(model, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(*model.value, parts)
        lot = TaskContext.get().partitionId() << 32
        held: list = []
        tokens = rows = 0

        def flush():
            counts, out = np.concatenate([c for _, c, _, _ in held]), np.concatenate([o for _, _, o, _ in held])
            known, base, blobs = dealer.lot(np.concatenate([h for h, _, _, _ in held]), counts, (~out).astype(np.int64))
            n = len(counts)
            none = pa.nulls(n, pa.int64())
            ids = pa.concat_arrays([i for _, _, _, i in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, lot)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(out), pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(base),
                 none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), none], _DEALT,
            )
            for part, pairs, entries, n in blobs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()),
                     pa.array([part], pa.int64()), pa.array([pairs], pa.binary()), pa.array([entries], pa.binary()), pa.array([n], pa.int64())], _DEALT,
                )

        for batch in batches:
            ids = batch.column(0)
            out = crc_remainder(ids.to_pylist(), FOLDS) == HELD
            for at, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                if held and len(words) > LOT_TOKENS:
                    yield from flush()
                    held, tokens, rows, lot = [], 0, 0, lot + 1
                held.append((words.hashes(), words.per_row(), out[at : at + words.rows], ids.slice(at, words.rows)))
                tokens, rows = tokens + len(words) + words.rows, rows + words.rows
                if tokens >= LOT_TOKENS or rows >= LOT_ROWS:
                    yield from flush()
                    held, tokens, rows, lot = [], 0, 0, lot + 1
        if held:
            yield from flush()

    return run


# ---- parts: the restaurants of contexts


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids ^ _GOLD) % np.uint64(buckets)).astype(np.int64)


_MOVED = "kind string, part long, bucket long, blob binary, a long, b long, c double"
_MOVED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, _MOVED_TYPES, strict=True)], names=["kind", "part", "bucket", "blob", "a", "b", "c"])


def _ups(part: int, words: np.ndarray, edges: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """The tables that a part has of each word, by bucket."""
    return [("up", part, k, pack(steps_of(words[x:y]), tables[x:y].astype(np.int32)), None, None, None)
            for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]


def unpack_pairs(blob) -> list[np.ndarray]:
    """Contexts, words, bucket edges, and of each pair its context, its word and its count."""
    contexts, words, edges, vi, wi, c = unpack(blob)
    return [contexts, sums_of(words), edges, sums_of(vi), sums_of(wi), c]


def _collect(buckets: int):
    """The pairs of a part, from all lots: state, and the number of pairs of each word."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found = [unpack(x) for x in table["pairs"].combine_chunks()]
        v, w, c = (np.concatenate([f[k] for f in found]) for k in range(3))
        contexts, vi = np.unique(v, return_inverse=True)
        words, wi = np.unique(w, return_inverse=True)
        to = bucket_of(words, buckets)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        words, wi = words[order], place[wi]
        edges = np.searchsorted(to[order], np.arange(buckets + 1))
        seen = c > 0
        pair = (vi[seen].astype(np.uint64) << np.uint64(32)) | wi[seen].astype(np.uint64)
        at = np.argsort(pair, kind="stable")
        pair, c = pair[at], c[seen][at].astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
        c, pair = np.add.reduceat(c, begin) if len(pair) else c, pair[begin]
        vi, wi = (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int32)
        state = pack(contexts, steps_of(words), edges, steps_of(vi), steps_of(wi), c.astype(np.int32))
        rows = [("pairs", part, None, state, int((c == 1).sum()), int((c == 2).sum()), None)]
        return _table(rows + _ups(part, words, edges, np.bincount(wi, minlength=len(words))))

    return run


def word_probability(c, t, h, sums: dict, known=True):
    """Probability of words in the restaurant of words, by their customers, tables and H; of an unknown one by what H leaves."""
    return np.where(known, (c - sums["d0"] * t + (STRENGTH + sums["d0"] * sums["tables"]) * h) / (STRENGTH + sums["customers"]), sums["p_unknown"])


def _seat_parts(turn: int, samples_wanted: int, sums: dict, hot):
    """One Gibbs sweep over the contexts of a part, given the restaurant of words."""

    def run(key: tuple[pa.Scalar, ...], state: pa.Table, replies: pa.Table) -> pa.Table:
        part, rng = key[0].as_py(), np.random.default_rng([turn, key[0].as_py()])
        held = {r["kind"]: r["blob"] for r in state.select(["kind", "blob"]).to_pylist()}
        contexts, words, edges, vi, wi, c = unpack_pairs(held["pairs"])
        answers = {b: unpack(x) for b, x in zip(replies["bucket"].to_pylist(), replies["blob"].to_pylist(), strict=True)}
        n = int(edges[-1])
        wc, wt, h, times = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.float32), np.zeros(n, np.int64)
        for k, found in answers.items():
            for own, x in zip((wc, wt, h, times), found, strict=True):
                own[edges[k] : edges[k + 1]] = x
        base, d = word_probability(wc, wt, h.astype(np.float64), sums, times > 0)[wi], sums["d1"]
        hot_ids, hot_c, hot_t = hot.value
        at = np.minimum(np.searchsorted(hot_ids, contexts), max(0, len(hot_ids) - 1))
        is_hot = hot_ids[at] == contexts if len(hot_ids) else np.zeros(len(contexts), dtype=bool)
        own_t = lambda t: np.bincount(vi, weights=t, minlength=len(contexts))
        samples = []
        if turn == 0:
            seats = Seats.start(c.astype(np.int64), vi, base, d, rng)
        else:
            old = unpack(held["seats"])
            seats, samples = Seats(old[0], old[1]), old[2:]
        in_room = own_t(seats.tables)
        outside = np.where(is_hot, hot_t[at], 0.0) - np.where(is_hot, in_room, 0.0) if len(hot_ids) and turn else np.zeros(len(contexts))
        in_room += outside
        seats.sweep(vi, in_room, base, d, rng)
        if turn >= BURN_IN:
            samples += [seats.tables.astype(np.int32), wc, wt]
        sizes = seats.sizes.astype(np.int32) if turn + 1 < BURN_IN + samples_wanted else np.zeros(0, dtype=np.int32)  # no sweep follows the last
        rows = [("seats", part, None, pack(seats.tables.astype(np.int32), sizes, *samples), int(seats.tables.sum()), None, None)]
        if turn == 0:
            rows.append(("counts", part, None, pack(times, h), None, None, None))
        if is_hot.any():
            mine = np.flatnonzero(is_hot)
            customers = np.bincount(vi, weights=c, minlength=len(contexts))
            rows.append(("hot", part, None, pack(contexts[mine], customers[mine], own_t(seats.tables)[mine]), None, None, None))
        if turn + 1 < BURN_IN + samples_wanted:
            rows += _ups(part, words, edges, np.bincount(wi, weights=seats.tables, minlength=len(words)))
        return _table(rows)

    return run


# ---- buckets: the restaurant of words


def _spelled(model, buckets: int):
    """(bucket, blob of ids, counts and H) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs, keys, numbers = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = word_ids(batch.column(2).to_numpy().view(np.uint64), keys, numbers)
            h, times, to = spell(batch.column(0), grams, logs), batch.column(1).to_numpy(), bucket_of(ids, buckets)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            blobs = [pack(ids[at], times[at], h[at].astype(np.float32)) for at in (order[edges[k] : edges[k + 1]] for k in some)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(blobs, pa.binary()), pa.array([float(h[order[edges[k] : edges[k + 1]]].astype(np.float32).sum(dtype=np.float64)) for k in some])], ["bucket", "blob", "mass"])

    return run


def _seat_words(turn: int, sums: dict):
    """One Gibbs sweep over the words of a bucket, whose customers are the tables of all parts; its state goes back to them."""

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, moved: pa.Table) -> pa.Table:
        bucket, rng = key[0].as_py(), np.random.default_rng([turn, 1, key[0].as_py()])
        found, old = [], None
        for kind, blob in zip(own["kind"].to_pylist(), own["blob"].to_pylist(), strict=True):
            if kind == "words":
                found.append(unpack(blob))
            else:
                old = unpack(blob)
        ids, times, h = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(ids)
        ids, times, h = ids[order], times[order], h[order].astype(np.float64)
        wanted, asked = np.zeros(len(ids), dtype=np.int64), []
        for part, blob in zip(moved["part"].to_pylist(), moved["blob"].to_pylist(), strict=True):
            words, tables = unpack(blob)
            words = sums_of(words)
            at = np.minimum(np.searchsorted(ids, words), max(0, len(ids) - 1))
            hit = ids[at] == words if len(ids) else np.zeros(len(words), dtype=bool)
            wanted += np.bincount(at[hit], weights=tables[hit], minlength=len(ids)).astype(np.int64)
            asked.append((part, at, hit))
        room, d = np.zeros(len(ids), dtype=np.int64), sums["d0"]
        if turn == 0:
            seats = Seats.start(wanted, room, h, d, rng) if len(ids) else Seats(wanted, wanted)
            in_room = np.array([float(sums["v"])])
        else:
            seats, in_room = Seats(old[0], old[1]), np.array([float(sums["tables"])])
            seats.become(wanted, room, in_room, h, d, rng)
        seats.sweep(room, in_room, h, d, rng)
        rows = [("root", None, bucket, pack(seats.tables.astype(np.int32), seats.sizes.astype(np.int32)), int(wanted.sum()), int(seats.tables.sum()), None)]
        state = (wanted.astype(np.int32), seats.tables.astype(np.int32), h.astype(np.float32), times)
        for part, at, hit in asked:
            rows.append(("reply", part, bucket, pack(*[np.where(hit, x[at], 0).astype(x.dtype) if len(ids) else np.zeros(len(at), dtype=x.dtype) for x in state]), None, None, None))
        return _table(rows)

    return run


# ---- scores


def base_of(times, n: int, v: int):
    """The contribution of a token to the base score."""
    return np.log10((times + 1.0) / (n + v + 1.0))


def predictive(c, tables, customers, in_room, p_word, discount):
    """Probability of a word after a context: of its customers and tables there, those of the restaurant, and its parent's probability."""
    return (c - discount * tables + (STRENGTH + discount * in_room) * p_word) / (STRENGTH + customers)


def _score_parts(sums: dict, hot):
    """Sums of a part over the rows of each lot: (known tokens, base, score) of their entries."""

    def run(key: tuple[pa.Scalar, ...], state: pa.Table, entries: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return pa.table({"lot": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        held = dict(zip(state["kind"].to_pylist(), state["blob"].to_pylist(), strict=True))
        contexts, words, _, vi, wi, c = unpack_pairs(held["pairs"])
        times, h = unpack(held["counts"])
        samples = unpack(held["seats"])[2:]
        samples = [(samples[k], word_probability(samples[k + 1], samples[k + 2], h.astype(np.float64), x, times > 0)) for k, x in zip(range(0, len(samples), 3), sums["samples"], strict=True)]
        pair = (vi.astype(np.uint64) << np.uint64(32)) | wi.astype(np.uint64)
        customers = np.bincount(vi, weights=c, minlength=len(contexts))
        hot_ids, hot_c, hot_t = hot.value
        at = np.minimum(np.searchsorted(hot_ids, contexts), max(0, len(hot_ids) - 1))
        is_hot = hot_ids[at] == contexts if len(hot_ids) else np.zeros(len(contexts), dtype=bool)
        if is_hot.any():
            customers = np.where(is_hot, hot_c[at], customers)
        rooms = []
        for k, (tables, _) in enumerate(samples):
            t = np.bincount(vi, weights=tables, minlength=len(contexts))
            rooms.append(np.where(is_hot, hot_t[k][at], t) if is_hot.any() else t)
        by_id = np.argsort(words)
        sorted_words = words[by_id]
        # numbered words are in the sums of the rows already
        rare = words >= _RARE
        base = np.where(rare, base_of(times, sums["n"], sums["v"]), 0.0)
        known = ((times > 0) & rare).astype(np.float64)
        lots, blobs = [], []
        for lot, pairs, blob in zip(entries["lot"].to_pylist(), entries["pairs"], entries["entries"], strict=True):
            v, w, _ = unpack(pairs)
            n, row, many = unpack(blob)
            x, y = np.searchsorted(contexts, v), by_id[np.searchsorted(sorted_words, w)]
            want = (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)
            at = np.minimum(np.searchsorted(pair, want), max(0, len(pair) - 1))
            hit = pair[at] == want if len(pair) else np.zeros(len(want), dtype=bool)
            p = np.zeros(len(want))
            for (tables, p_word), in_room in zip(samples, rooms, strict=True):
                t = np.where(hit, tables[at], 0) if len(pair) else 0
                p += predictive(np.where(hit, c[at], 0) if len(pair) else 0, t, customers[x], in_room[x], p_word[y], sums["d1"])
            size = int(row.max()) + 1
            add = lambda value: np.bincount(row, weights=np.repeat(value, n) * many, minlength=size)  # noqa: E731, B023
            lots.append(lot)
            blobs.append(pack(add(known[y]).astype(np.int32), add(base[y]), add(np.log10(p / len(rooms))).astype(np.float32)))
        return pa.table({"lot": pa.array(lots, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _add_lots(names: list[str]):
    """The rows of a lot with the sums of all parts."""

    def run(key: tuple[pa.Scalar, ...], heads: pa.Table, sums: pa.Table) -> pa.Table:
        row = heads["row"].to_numpy()
        size = int(row.max()) + 1 if len(row) else 0
        known, base, score = np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size)
        known[row], base[row] = heads["n_known"].to_numpy(), heads["base"].to_numpy()
        for blob in sums["blob"]:
            k, b, s = unpack(blob)
            known[: len(k)] += k
            base[: len(b)] += b
            score[: len(s)] += s
        return pa.table([heads["id"], heads["held_out"], heads["n_tokens"], pa.array(known[row]), pa.array(base[row]), pa.array(score[row])], names=names)

    return run


class Model(NamedTuple):
    """A trained model: the dealt texts, the state of the parts (both tables in the shared folder), and totals."""

    dealt: DataFrame
    state: DataFrame | None
    sums: dict[str, float]
    hot: Broadcast | None
    tables: tuple[DataFrame, ...]


def train(docs: DataFrame) -> Model:
    """Trains on the training rows of ``docs`` (id, text), and deals all rows to the parts that score them.

    The driver holds the grams of the spelling model (at most 258**3), a numbered
    table of at most ``FREQUENT`` words, and totals of the contexts with more
    than half a part's tokens, of which there are at most two a part.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    counted = cut(docs.mapInArrow(_count_words, "word string, times long").groupBy("word").agg(F.sum("times").alias("times")), "counted")
    with arrow_rows(spark, WORD_ROWS):
        words = cut(counted.mapInArrow(_hashed, "word string, times long, h long"), "words")
    drop(counted)
    stats = words.agg(
        F.sum("times").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("times") == 1, 1).otherwise(0)).alias("ones"), F.sum(F.when(F.col("times") == 2, 1).otherwise(0)).alias("twos"),
    ).first()
    n, v = int(stats["n"] or 0), int(stats["v"])
    parts, buckets = max(LEAST_PARTS, -(-n // PART_TOKENS)), max(LEAST_PARTS, -(-v // BUCKET_WORDS))
    top = most_frequent(words, FREQUENT).select("h", "times").toArrow()
    h, times = top["h"].to_numpy().view(np.uint64), top["times"].to_numpy()
    numbers = np.empty(len(h), dtype=np.uint64)
    numbers[np.lexsort((h, -times))] = np.arange(len(h), dtype=np.uint64)
    order = np.argsort(h)
    keys, numbers, times = h[order], numbers[order], times[order]
    # a context's tokens are its word's, so hot ones are known before pairs are counted: at most 2 a part
    many = words.where(F.col("times") > PART_TOKENS // 2).select("h", "times").toArrow()
    ids, many = word_ids(many["h"].to_numpy().view(np.uint64), keys, numbers), many["times"].to_numpy()
    order = np.argsort(ids)
    hot_ids, splits = ids[order], -(-many[order] // (PART_TOKENS // 2))
    base = np.zeros(len(keys))
    base[numbers.astype(np.int64)] = base_of(times, n, v)
    model = spark.sparkContext.broadcast((keys, numbers, base, hot_ids, splits))
    schema = f"lot long, row int, id {kind}, held_out boolean, n_tokens long, n_known long, base double, part long, pairs binary, entries binary, n long"
    dealt = cut(docs.mapInArrow(_deal(model, parts), schema), "dealt")
    sums = {"n": n, "v": v, "d0": discount_of(stats["ones"] or 0, stats["twos"] or 0), "p_unknown": 1.0, "tables": 0.0, "customers": 0.0, "d1": 0.5}
    if not n:
        return Model(dealt, None, sums, None, (words,))
    # the base: a spelling model of the distinct words
    with arrow_rows(spark, WORD_ROWS):
        grams = words.select("word").mapInArrow(_count_grams, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toArrow()
    spelling = Spelling(grams["gram"].to_numpy(), grams["times"].to_numpy(), CONTEXT, np.random.default_rng(6))
    p = 0.0
    for turn in range(SPELL_BURN_IN + SPELL_SAMPLES):
        spelling.sweep()
        if turn >= SPELL_BURN_IN:
            p = p + spelling.probabilities()[0] / SPELL_SAMPLES
    spoken = spark.sparkContext.broadcast((spelling.grams[0], np.log(p), keys, numbers))
    with arrow_rows(spark, WORD_ROWS):
        spelled = cut(words.mapInArrow(_spelled(spoken, buckets), "bucket long, blob binary, mass double"), "spelled")
    unknown = max(1e-9, 1.0 - (spelled.agg(F.sum("mass")).first()[0] or 0.0))
    drop(words)
    spelled_table = spelled
    spelled = spelled.select(F.lit("words").alias("kind"), F.lit(None).cast("long").alias("part"), "bucket", "blob")
    collected = cut(dealt.where("part is not null").select("part", "pairs").groupBy("part").applyInArrow(_collect(buckets), _MOVED), "pairs", by="kind")
    pairs = collected.where("kind = 'pairs'")
    ones, twos = pairs.agg(F.sum("a"), F.sum("b")).first()
    sums["d1"] = discount_of(ones or 0, twos or 0)
    moved, seats, counts, root = collected, None, None, None
    hot_state = (hot_ids, np.zeros(len(hot_ids)), np.zeros(len(hot_ids)))
    hot_tables: list[np.ndarray] = []
    samples: list[dict[str, float]] = []
    columns = ["kind", "part", "bucket", "blob"]
    for turn in range(BURN_IN + SAMPLES):
        own = spelled if root is None else spelled.unionByName(root.where("kind = 'root'").select(columns))
        ups = moved.where("kind = 'up'").select(columns)
        new_root = cut(own.groupBy("bucket").cogroup(ups.groupBy("bucket")).applyInArrow(_seat_words(turn, dict(sums)), _MOVED), "root")
        drop(*([root] if root is not None else []), *([spelled_table] if turn + 1 == BURN_IN + SAMPLES else []))
        root = new_root
        drop_kind(moved, "up")  # the buckets have them now
        total = root.where("kind = 'root'").agg(F.sum("a").alias("c"), F.sum("b").alias("t")).first()
        sums["customers"], sums["tables"] = float(total["c"]), float(total["t"])
        sums["p_unknown"] = (STRENGTH + sums["d0"] * sums["tables"]) / (STRENGTH + sums["customers"]) * unknown
        hot = spark.sparkContext.broadcast(hot_state)
        state = pairs if seats is None else pairs.unionByName(seats)
        replies = root.where("kind = 'reply'").select(columns)
        new = cut(state.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_seat_parts(turn, SAMPLES, dict(sums), hot), _MOVED), "seats", by="kind")
        if turn == 0:
            counts = cut(new.where("kind = 'counts'"), "counts")
        elif turn > 0:
            drop(moved)
        moved, seats = new, new.where("kind = 'seats'")
        totals = np.zeros((2, len(hot_ids)))
        for r in moved.where("kind = 'hot'").select("blob").collect():  # at most 2 contexts a part
            ids, c, t = unpack(r["blob"])
            np.add.at(totals, (slice(None), np.searchsorted(hot_ids, ids)), np.array([c, t]))
        hot_state = (hot_ids, totals[0], totals[1])
        if turn >= BURN_IN:
            hot_tables.append(totals[1])
            samples.append({k: sums[k] for k in ("d0", "customers", "tables", "p_unknown")})
    hot = spark.sparkContext.broadcast((hot_ids, hot_state[1], hot_tables))
    drop(root)
    return Model(dealt, pairs.unionByName(seats).unionByName(counts), sums | {"samples": samples}, hot, (collected, moved, counts))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learned from the rows whose crc32(id as text) mod 7 is not 2. ``score`` is the
    log10 probability of the text's words and its end, each given the word before
    it (the first one given the begin of a text). ``perplexity`` sums scores.

    A null or wordless text is one token, the end. Repeated rows and null ids
    (remainder of the empty text) are rows of their own. Without training rows
    every token is unknown with probability 1. Extra columns are ignored; an
    empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    tune(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    model = train(own)
    heads = model.dealt.where("part is null").select("lot", "row", "id", "held_out", "n_tokens", "n_known", "base")
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    if model.state is None:
        out = heads.select("id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    else:
        entries = model.dealt.where("part is not null").select("part", "lot", "pairs", "entries", "n")
        # where a part has more entries than a task should hold, lots are dealt to copies of its state
        loads = entries.groupBy("part").agg(F.ceil(F.sum("n") / (2 * PART_TOKENS)).cast("int").alias("copies"))
        entries = entries.join(loads, "part").withColumn("copy", F.pmod(F.xxhash64("lot"), F.col("copies")).cast("int")).drop("copies", "n")
        state = model.state.select("part", "kind", "blob").join(loads, "part").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        sums = None
        for k in range(SLICES):  # so that only a share of the entries lies in a shuffle at once
            own, met = (x.where(F.col("part") % SLICES == k).groupBy("part", "copy") for x in (state, entries))
            some = cut(own.cogroup(met).applyInArrow(_score_parts(model.sums, model.hot), "lot long, blob binary"), "sums")
            sums = some if sums is None else sums.unionByName(some)
        drop(*model.tables)
        schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        out = heads.groupBy("lot").cogroup(sums.groupBy("lot")).applyInArrow(_add_lots(names), schema)
    sweep(spark)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.sums["n"]).cast("long").alias("train_tokens"), "base_score", "score",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of the result of ``score``."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(
        tokens.alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
    )
