"""Vectorised word kernels over Arrow string buffers.

The kernels work on the UTF-8 bytes of many texts at once: word boundaries by a
table of separators, word hashes by mixing blocks of eight bytes one after the
other, so no Python object is made per word. Words are runs of
``[^\\x20\\x09-\\x0D]``; only A-Z is folded.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _steady_memory() -> None:
    """Large arrays go back to the system when they are freed.

    A Python worker lives through many tasks of many operators; without this the
    allocator keeps the largest of each for good.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD
    except OSError:
        pass  # another C library has its own ways


_steady_memory()

#: Bytes of text handled at once; bounds memory at about 40 times as much.
CHUNK_BYTES = 1 << 20
#: Texts handled at once.
CHUNK_ROWS = 1000

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACES = _SEP
#: All of ASCII but letters, and all of ASCII but letters and digits; bytes of other characters never separate.
NOT_LETTERS = np.arange(256) < 128
NOT_LETTERS[np.r_[65:91, 97:123]] = False
NOT_ALNUM = NOT_LETTERS.copy()
NOT_ALNUM[48:58] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes up to which a word is hashed in blocks; longer ones go through BLAKE2.
LONG_WORD = 64
#: Masks that keep the first k bytes of a block.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` as one number; zeros follow its end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges; different ``lane``s are independent hashes.

    Each block of eight bytes passes through a bijection with what came before it,
    so no arrangement of letters cancels out. Ranges of one length of up to eight
    bytes never collide.
    """
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((0xA0761D6478BD642F * (2 * lane + 1)) % 2**64))
    if not len(size):
        return h
    at = _blocks(data)
    h = mix(h ^ (at[start] & _FIRST[np.minimum(size, 8)]))
    live, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        h[live] = mix(h[live] ^ (at[start[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return h


def same_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each range of ``data`` holds the same bytes as its partner in ``other``."""
    size = end - start
    same = size == other_end - other_start
    if not len(size):
        return same
    one, two = _blocks(data), _blocks(other)
    live, k = np.flatnonzero(same & (size > 0)), 0
    while len(live) and k < LONG_WORD:
        keep = _FIRST[np.minimum(size[live] - k, 8)]
        equal = ((one[start[live] + k] ^ two[other_start[live] + k]) & keep) == 0
        same[live[~equal]] = False
        k += 8
        live = live[equal & (size[live] > k)]
    for i in live.tolist():
        same[i] = data[start[i] + k : end[i]].tobytes() == other[other_start[i] + k : other_end[i]].tobytes()
    return same


class Words:
    """The words of some texts: ``row`` of each, ``start`` and ``end`` byte in ``data``."""

    __slots__ = ("data", "row", "start", "end", "rows", "offsets", "low")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, sep: np.ndarray = _SEP):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        solid = ~sep[data]
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = solid.copy()
        begins[1:] &= ~(solid[:-1]) | first[1:n]
        ends = solid.copy()
        ends[:-1] &= ~(solid[1:]) | first[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.low = FOLD[data] if fold else data

    def __len__(self) -> int:
        return len(self.start)

    def strings(self) -> pa.Array:
        """The words, folded, as an Arrow array."""
        size = self.end - self.start
        edges = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start - edges[:-1], size) + np.arange(edges[-1])
        kept = np.ascontiguousarray(self.low[at])
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(kept))

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def hashes(self, data: np.ndarray | None = None, lane: int = 0) -> np.ndarray:
        """64-bit hashes of the words (of ``data``, the folded bytes by default)."""
        return range_hashes(self.low if data is None else data, self.start, self.end, lane)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of at most ``limit`` bytes and ``CHUNK_ROWS`` rows, or of one row. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    _, raw_offsets, raw = texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, at + CHUNK_ROWS, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def pieces(texts: pa.Array, sep: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, whether its row ends here) of ``chunks``, a text of over ``limit`` bytes in several.

    Such a text is cut behind separators, at the first one beyond each ``limit``
    bytes, so that no word is; its pieces follow each other and have one row each.
    """
    for at, data, offsets in chunks(texts, limit):
        if len(offsets) > 2 or len(data) <= limit:
            yield at, data, offsets, True
            continue
        done = 0
        while done < len(data):
            to = min(done + limit, len(data))
            while to < len(data) and not sep[data[to - 1]]:
                gaps = np.flatnonzero(sep[data[to : to + limit]])
                to = to + int(gaps[0]) + 1 if len(gaps) else min(to + limit, len(data))
            yield at, data[done:to], np.array([0, to - done]), to == len(data)
            done = to


def windows(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``width`` consecutive words; a shorter row with words is one window."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    factor = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) % 2**64 | 1) for k in range(width)]
    m = max(0, n - width + 1)
    h = np.full(m, width, dtype=np.uint64)
    for k in range(width):
        h += mix(hashes[k : k + m] ^ factor[k]) * factor[k]
    full = row[:m] == row[width - 1 :] if m else np.zeros(0, dtype=bool)
    out_row, out = row[:m][full], mix(h[full])
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        h = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            h[has] += mix(hashes[first[short[has]] + k] ^ factor[k]) * factor[k]
        out_row, out = np.concatenate((out_row, short)), np.concatenate((out, mix(h)))
        order = np.argsort(out_row, kind="stable")
        out_row, out = out_row[order], out[order]
    return out_row, out


def crc_remainder(ids, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``modulus``; a null id counts as the text ''."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], dtype=np.int64)
