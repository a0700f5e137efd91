"""Streams of compound files: sectors in chains, small streams in a stream of their own."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Fixed values of the format: its first bytes, the marks of chains, and kinds of directory entries.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE, TABLE, MORE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC
STORAGE, STREAM, ROOT = 1, 2, 5
ENTRY, IN_HEADER = 128, 109


class Damaged(ValueError):
    """The file breaks the format: a chain that leaves it, or comes back to itself."""


class Compound:
    """A compound file in memory. ``paths`` lists its streams; ``read`` gives the bytes of one."""

    def __init__(self, content: bytes):
        if not is_compound(content) or len(content) < 512:
            raise Damaged("not a compound file")
        self.content = content
        self.size, self.small = (1 << x for x in struct.unpack_from("<HH", content, 30))
        if not 512 <= self.size <= 1 << 20 or not 1 <= self.small <= self.size:
            raise Damaged("sector sizes")
        tables, directory = struct.unpack_from("<I", content, 44)[0], struct.unpack_from("<I", content, 48)[0]
        self.cutoff, small_first, _, more, _ = struct.unpack_from("<5I", content, 56)
        found = list(struct.unpack_from(f"<{IN_HEADER}I", content, 76))
        seen = set()
        while more < TABLE - 1 and len(found) < tables:
            if more in seen:
                raise Damaged("table of tables")
            seen.add(more)
            *some, more = self._numbers(self._sector(more))
            found += some
        self.next = [n for t in found[:tables] for n in self._numbers(self._sector(t))]
        self.small_next = list(self._numbers(self._chain(small_first))) if small_first < TABLE - 1 else []
        raw = self._chain(directory)
        self.entries = [self._entry(raw[a : a + ENTRY]) for a in range(0, len(raw) - ENTRY + 1, ENTRY)]
        if not self.entries or self.entries[0][1] != ROOT:
            raise Damaged("no root")
        self.small_data = self._chain(self.entries[0][5]) if self.entries[0][5] < TABLE - 1 else b""
        self.paths = dict(self._walk())

    @staticmethod
    def _numbers(data: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.content):
            raise Damaged("a sector beyond the end")
        return self.content[at : at + self.size]

    def _chain(self, first: int) -> bytes:
        return b"".join(self._sector(n) for n in self._links(first, self.next))

    @staticmethod
    def _links(n: int, following: list[int]) -> Iterator[int]:
        left = len(following)
        while n != END:
            if n >= len(following) or left == 0:
                raise Damaged("a chain without an end")
            yield n
            n, left = following[n], left - 1

    @staticmethod
    def _entry(raw: bytes) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, bytes)."""
        length, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<3I", raw, 68)
        first, size = struct.unpack_from("<IQ", raw, 116)
        return raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, first, size

    def _walk(self) -> Iterator[tuple[tuple[str, ...], int]]:
        """Paths of streams and their entries; siblings are a tree of their own, whose shape doesn't matter."""
        todo, seen = [(self.entries[0][4], ())], set()
        while todo:
            n, above = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, *_ = self.entries[n]
            todo += [(left, above), (right, above)]
            if kind == STORAGE:
                todo.append((child, (*above, name)))
            elif kind == STREAM:
                yield (*above, name), n

    def read(self, *path: str) -> bytes:
        """The bytes of a stream; ``KeyError`` if there is none."""
        _, _, _, _, _, first, size = self.entries[self.paths[path]]
        if not size:
            return b""
        if size >= self.cutoff:
            data = self._chain(first)
        else:
            data = b"".join(self.small_data[n * self.small : (n + 1) * self.small] for n in self._links(first, self.small_next))
        if len(data) < size:
            raise Damaged("a stream shorter than its size")
        return data[:size]


def is_compound(content: bytes) -> bool:
    return content[: len(MAGIC)] == MAGIC
