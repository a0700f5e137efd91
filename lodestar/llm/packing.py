"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.runtime import cut, tune
from lodestar.llm.textkernels import FOLD, Words, chunks, same_ranges

WINDOW = 4096
END_ID = 2
#: Rows of one length are numbered in so many independent parts.
PARTS = 256
#: Words whose ids a worker keeps, and their bytes; beyond either the memory is emptied.
KNOWN_WORDS, KNOWN_BYTES = 600_000, 1 << 25


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by way of their words.

    The tokenizer never joins anything across ASCII white space, and within a
    word of plain letters, digits and punctuation it splits at every change
    between letters and others and after each digit. So such words are cut there
    and other words are kept whole, letters are folded as the tokenizer does,
    and each distinct unit is encoded once a worker; a text's ids are those of
    its units in turn. Units are found by hash and their bytes are compared with
    those that were encoded; one that differs is encoded on its own.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)], dtype=bool)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")
        self.raw_begin = np.zeros(0, dtype=np.int64)
        self.raw_end = np.zeros(0, dtype=np.int64)
        self.raw = np.zeros(0, dtype=np.uint8)

    def _encode_units(self, units: list[str], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in turn, number of ids of each). Simple units end with a closing id, so they go as one text."""
        parts, counts = [], np.zeros(len(units), dtype=np.int64)
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        many = int(simple.sum())
        for at in range(0, many, 4096):
            to = min(many, at + 4096)
            ids = np.array(self.tokenizer.encode(" ".join(units[i] for i in order[at:to]), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != to - at:
                raise ValueError("the tokenizer does not close every unit")
            counts[order[at:to]] = np.diff(ends, prepend=0)
            parts.append(ids)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in order[many:]], add_special_tokens=False)]
        counts[order[many:]] = [len(x) for x in found]
        parts += [np.array(x, dtype="<u4") for x in found]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        # back to the order of the units
        begin = np.zeros(len(units), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        take = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
        return ids[take], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        words = Words(data, offsets, fold=False)
        if not len(words):
            return np.zeros(0, dtype="<u4"), np.zeros(words.rows, dtype=np.int64)
        folded, simple_word = units_of(words)
        hashes = words.hashes(folded)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS or len(self.raw) > KNOWN_BYTES:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        if len(new):
            spots = where[new]
            ids, counts = self._encode_units(_strings(folded, words.start[spots], words.end[spots]), simple_word[spots])
            begin = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate((self.pool, ids))
            size = words.end[spots] - words.start[spots]
            raw_end = len(self.raw) + np.cumsum(size)
            take = np.repeat(words.start[spots] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self.raw = np.concatenate((self.raw, folded[take]))
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.begin, self.count = np.insert(self.begin, at[new], begin), np.insert(self.count, at[new], counts)
            self.raw_begin, self.raw_end = np.insert(self.raw_begin, at[new], raw_end - size), np.insert(self.raw_end, at[new], raw_end)
            at = np.searchsorted(self.keys, unique)
        at = at[inverse]
        begin, count, pool = self.begin[at], self.count[at], self.pool
        other = np.flatnonzero(~same_ranges(folded, words.start, words.end, self.raw, self.raw_begin[at], self.raw_end[at]))
        if len(other):
            ids, count[other] = self._encode_units(_strings(folded, words.start[other], words.end[other]), simple_word[other])
            begin[other] = len(pool) + np.cumsum(count[other]) - count[other]
            pool = np.concatenate((pool, ids))
        ends = np.cumsum(count)
        take = np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]))
        before = np.concatenate(([0], ends))
        per_row = np.diff(before[np.searchsorted(words.start, offsets)])
        return pool[take], per_row


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]


#: Classes of bytes: 1 letters, 2 digits, 3 other printable ASCII, 0 all else.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 1


def units_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Cuts the words of ``words``, in place, into units; (folded bytes, which units are simple).

    Letters are ASCII letters and the two-byte letters U+00C0 to U+00FF. A word
    with an apostrophe, a ``<|`` or any other byte is one unit, as it is.
    """
    data, n = words.data, len(words.data)
    kind = _KIND[data]
    lead = np.zeros(n + 1, dtype=bool)
    lead[:-1] = data == 0xC3
    after = np.zeros(n, dtype=bool)
    after[1:] = lead[: n - 1]
    letter2 = after & (data != 0x97) & (data != 0xB7) & (data >= 0x80)
    kind[letter2] = 1
    kind[np.flatnonzero(letter2) - 1] = 1
    odd = (kind == 0) | (data == 0x27)
    bar = data == 0x7C
    odd[1:] |= bar[1:] & (data[:-1] == 0x3C)
    sums = np.concatenate(([0], np.cumsum(odd)))
    simple = sums[words.end] == sums[words.start]
    low = FOLD[data]
    upper2 = letter2 & (data < 0x9F)
    low[upper2] += 0x20
    inside = np.zeros(n + 1, dtype=np.int8)  # bytes of simple words
    inside[words.start[simple]] += 1
    inside[words.end[simple]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    keep = np.where(inside, low, data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut[words.start] = False
    extra = np.flatnonzero(cut)
    starts = np.concatenate((words.start, extra))
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    owner = np.searchsorted(words.start, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], n), words.end[owner])
    words.start, words.end, words.row = starts, ends, words.row[owner]
    return keep, simple[owner]


_workers: dict[int, WordIds] = {}


def _pieces(spec, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(spec.value.encode())
        if key not in _workers:
            _workers[key] = WordIds(spec.value)
        coder = _workers[key]
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for at, data, offsets in chunks(batch.column(1)):
                ids, per_row = coder.encode(data, offsets)
                to = 0
                for k, n in enumerate(per_row.tolist()):
                    own = np.append(ids[to : to + n], np.uint32(end_id)).astype("<u4")
                    to += n
                    for s in range(0, n + 1, window):
                        part = own[s : s + window]
                        rows.append(at + k)
                        starts.append(s)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                        totals.append(n + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]],
                ["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def fullest(capacity: int, lengths: list[int], left: dict[int, int]) -> tuple[int, dict[int, int]]:
    """The multiset of ``left`` whose sum is closest to ``capacity`` from below.

    Bit s of ``reach`` says that sum s can be made of the lengths so far. Counts
    enter by binary splitting; the bitsets before each length are kept, and
    going back through them gives the count of each length. ``lengths`` descend.
    """
    reach, full, stages = 1, (1 << (capacity + 1)) - 1, []
    for length in lengths:
        most = min(left.get(length, 0), capacity // length) if length <= capacity else 0
        if not most:
            continue
        stages.append((length, reach))
        step = 1
        while most:
            some = min(step, most)
            reach |= (reach << (length * some)) & full
            most -= some
            step *= 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(stages):
        while not before >> at & 1:
            at -= length
            taken[length] = taken.get(length, 0) + 1
    return best, taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(first sequence, how many alike, [(length, count in each)])] that uses every piece once.

    Each window starts from the longest remaining piece and is filled with least
    slack; the same filling repeats while the counts last, so the number of
    fillings is bounded by the number of distinct lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left, reverse=True)
    out, sequence = [], 0
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        _, taken = fullest(window - seed, lengths, left)
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[n] // c for n, c in taken.items())
        out.append((sequence, times, sorted(taken.items(), reverse=True)))
        sequence += times
        for n, c in taken.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return out


def _placing(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, each, offset = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")],
                 pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + (nth % each[at]) * length)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and then ``end_id``; it is cut every ``window`` ids.
    Only the histogram of piece lengths (at most ``window`` rows) comes to the
    driver, where windows are filled with least slack; pieces of a length are
    numbered in parts, so that no length gathers in one task, and find their
    place by their number in the plan, whose size depends on ``window`` alone.

    A null or empty text is one piece of one id. Repeated rows and null ids are
    documents of their own. Extra columns are ignored; an empty table gives an
    empty result. ``tokenizer_path`` is read on the driver.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut(docs.select(id_col, text_col).mapInArrow(_pieces(spec, window, end_id), columns), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(PARTS)).cast("int"))
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    used: dict[int, int] = {}
    entries = []
    for sequence, times, items in plan(counts, window):
        offset = 0
        for length, each in items:
            first = used.get(length, 0)
            entries.append((length * (1 << 48) + first, first, sequence, each, offset))
            used[length] = first + each * times
            offset += each * length
    table = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(entries), strict=True)) if entries else (np.zeros(0, dtype=np.int64),) * 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32"))
    ranked = pieces.withColumn("nth", nth).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    out = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_placing(table), columns + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
