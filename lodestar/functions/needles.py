"""Many literals looked for at once: an automaton in arrays, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an automaton's table at most: what is broadcast. More literals are looked for in several passes.
TABLE_BYTES = 64 << 20
#: Bytes of text that are read side by side, and of one lane.
CHUNK, LANE = 1 << 22, 1024
#: Hits that leave in one batch.
OUT = 2048


class Automaton:
    """Aho and Corasick's automaton of byte strings, completed: a row of next states for each state and class of bytes.

    Empty literals are never found.
    """

    def __init__(self, literals: list[bytes]):
        used = sorted({b for x in literals for b in x})
        self.of = np.zeros(256, dtype=np.int32)
        self.of[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1  # class 0: bytes that no literal has
        children: list[dict[int, int]] = [{}]
        parent, by, depth, ends = [0], [0], [0], {}
        for number, x in enumerate(literals):
            s = 0
            for c in self.of[np.frombuffer(x, dtype=np.uint8)].tolist():
                t = children[s].get(c)
                if t is None:
                    t = children[s][c] = len(children)
                    children.append({})
                    parent.append(s)
                    by.append(c)
                    depth.append(depth[s] + 1)
                s = t
            if x:
                ends.setdefault(s, []).append(number)
        n = len(children)
        parent, by, depth = (np.array(a, dtype=np.int64) for a in (parent, by, depth))
        self.table = np.zeros((n, self.width), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        edge = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
        for d in range(int(depth.max()) + 1):
            level = order[edge[d] : edge[d + 1]]
            below = order[edge[d + 1] : edge[d + 2]] if d < depth.max() else order[:0]
            if d:
                # what fails goes on where its longest proper suffix would
                fail[level] = self.table[fail[parent[level]], by[level]] if d > 1 else 0
                self.table[level] = self.table[fail[level]]
            self.table[parent[below], by[below]] = below
        self.longest = int(depth.max())
        # literals that end in a state: its own, then those of the nearest suffix that has any
        self.found: list[list[int]] = [[]] * n
        for s in order.tolist():
            more = self.found[fail[s]] if s else []
            self.found[s] = ends.get(s, []) + more if s in ends else more
        self.says = np.array([bool(x) for x in self.found])
        self.flat = np.ascontiguousarray(self.table.ravel())

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, literal, byte behind the occurrence) of texts that lie in ``data``, in no order.

        Texts are cut into lanes that are read side by side, a byte of each at a time.
        A lane begins early enough to be in the right state where its own bytes begin.
        """
        size = np.diff(offsets)
        lane = max(LANE, 4 * self.longest)
        many = -(-size // lane)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        own = offsets[text] + nth * lane
        begin = np.maximum(offsets[text], own - (self.longest - 1))
        end = np.minimum(own + lane, offsets[text + 1])
        order = np.argsort(begin - end, kind="stable")
        text, own, begin, end = text[order], own[order], begin[order], end[order]
        length = end - begin
        classes = self.of[data]
        state = np.zeros(len(text), dtype=np.int64)
        live = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0))  # lanes longer than t
        lanes, places, states = [], [], []
        for t, m in enumerate(live.tolist()):
            at = begin[:m] + t
            now = self.flat[state[:m] * self.width + classes[at]]
            state[:m] = now
            says = np.flatnonzero(self.says[now])
            if len(says):
                says = says[at[says] >= own[says]]
                lanes.append(says)
                places.append(at[says] + 1)
                states.append(now[says])
        if not lanes:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        lanes, places, states = np.concatenate(lanes), np.concatenate(places), np.concatenate(states)
        each = [self.found[s] for s in states.tolist()]
        count = np.array([len(x) for x in each], dtype=np.int64)
        return text[np.repeat(lanes, count)], np.array([i for x in each for i in x], dtype=np.int64), np.repeat(places, count)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``CHUNK`` bytes, one at least; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _apart(row: np.ndarray, needle: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the occurrences, sorted by row, literal and place, are left when none overlaps one before it."""
    keep = np.ones(len(row), dtype=bool)
    same = (row[1:] == row[:-1]) & (needle[1:] == needle[:-1])
    for i in (np.flatnonzero(same & (start[1:] < (start + size)[:-1])) + 1).tolist():
        j = i - 1
        while not keep[j]:
            j -= 1
        keep[i] = not (row[j] == row[i] and needle[j] == needle[i] and start[i] < start[j] + size[j])
    return keep


def _matcher(shared, first: bool, pad: int | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, sizes, empty = shared.value
        for batch in batches:
            known = batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            for at, data, offsets in _chunks(batch.column(batch.num_columns - 1)):
                row, needle, end = automaton.hits(data, offsets) if automaton else (np.zeros(0, dtype=np.int64),) * 3
                start = end - sizes[needle]
                if len(empty):  # the empty literal is at the begin of every text
                    rows = np.flatnonzero(known[at : at + len(offsets) - 1])
                    row, needle, start = np.concatenate((row, np.repeat(rows, len(empty)))), np.concatenate((needle, np.tile(empty, len(rows)))), np.concatenate((start, np.repeat(offsets[rows], len(empty))))
                order = np.lexsort((start, needle, row))
                row, needle, start = row[order], needle[order], start[order]
                if first:
                    keep = np.ones(len(row), dtype=bool)
                    keep[1:] = (row[1:] != row[:-1]) | (needle[1:] != needle[:-1])
                else:
                    keep = _apart(row, needle, start, sizes[needle])
                row, needle, start = row[keep], needle[keep], start[keep]
                # places in characters
                chars = np.flatnonzero((data & 0xC0) != 0x80)
                base = np.searchsorted(chars, offsets)
                place, behind = np.searchsorted(chars, start), np.searchsorted(chars, start + sizes[needle])
                for a in range(0, len(row), OUT):
                    r, n = row[a : a + OUT], needle[a : a + OUT]
                    columns = [c.take(pa.array(at + r)) for c in batch.columns[:-1]] + [c.take(pa.array(n)) for c in held.columns]
                    columns.append(pa.array((place[a : a + OUT] - base[r]).astype(np.int32)))
                    if pad is not None:
                        low = np.maximum(base[r], place[a : a + OUT] - pad)
                        high = np.minimum(base[r + 1], behind[a : a + OUT] + pad)
                        edge = np.append(chars, len(data))
                        columns.append(pa.array((place[a : a + OUT] - low).astype(np.int32)))
                        columns.append(pa.array([data[x:y].tobytes().decode() for x, y in zip(edge[low], edge[high], strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def matches(rows: DataFrame, text_col: str, needles: DataFrame, needle_col: str, first: bool = False, pad: int | None = None) -> DataFrame:
    """The columns of ``rows`` but the text, those of ``needles``, and ``start`` of each occurrence of a needle in a text, in characters from 0.

    Occurrences of one needle that overlap an earlier one don't count; with
    ``first``, only the first of each needle and text does. With ``pad``, ``around`` is the occurrence
    with so many characters on each side, in which it begins at ``at``.

    Needles come to the driver in blocks whose automaton takes at most
    ``TABLE_BYTES``, as their bytes tell beforehand; one block is the rule, and
    each block reads the texts once, at a cost that doesn't depend on how many
    needles it has. A null needle or text matches nothing; an empty needle is at the begin of
    every text. Needles that repeat are found as often.
    """
    spark = rows.sparkSession
    keys = [c for c in rows.columns if c != text_col]
    clash = set(keys) & set(needles.columns)
    if clash:
        raise ValueError(f"rows and needles share columns: {sorted(clash)}")
    asked = needles.where(F.col(needle_col).isNotNull())
    total = asked.agg(F.sum(F.octet_length(needle_col))).collect()[0][0] or 0
    blocks = max(1, -(-total * 4 * 257 // TABLE_BYTES)) if total * 4 * 257 > TABLE_BYTES else 1
    if blocks > 1:
        # the width of the table is that of the bytes that needles use
        used = asked.select(F.explode(F.array_distinct(F.split(F.hex(F.encode(needle_col, "utf-8")), "(?<=\\G..)"))).alias("b")).where("b <> ''").distinct().count()
        blocks = max(1, -(-total * 4 * (used + 1) // TABLE_BYTES))
    names = [*keys, *needles.columns, "start", *(["at", "around"] if pad is not None else [])]
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *needles.schema]}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string' if c == 'around' else 'int')}" for c in names)
    out = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(needle_col), F.lit(blocks)) == k).toArrow().combine_chunks()  # at most about TABLE_BYTES of states
        literals = [x.encode() for x in block[needle_col].to_pylist()]
        held = pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in block.columns], block.schema.names)
        full = [i for i, x in enumerate(literals) if x]
        empty = np.array([i for i, x in enumerate(literals) if not x], dtype=np.int64)
        automaton = Automaton(literals) if full else None
        shared = spark.sparkContext.broadcast((automaton, held, np.array([len(x) for x in literals], dtype=np.int64), empty))
        met = rows.select(*keys, text_col).mapInArrow(_matcher(shared, first, pad, names), schema)
        out = met if out is None else out.unionByName(met)
    return out
