"""Lines of text with their sizes from PDF files: the parser for ``pages.parse_files``.

Read are cross-reference tables and streams, object streams, Flate with
predictors, page trees, forms and fonts with a map to Unicode or a simple
encoding. What is encrypted, packed otherwise or damaged raises, so that the file
keeps a status. Tables are not found: they are drawn, not written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from math import hypot
from typing import NamedTuple

#: Bytes that one stream may unpack to; more raises.
MOST_BYTES = 1 << 28
#: A gap in a shown array, in thousandths of the size, from which on it is a space.
GAP = 200
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_PLAIN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    about: dict
    raw: bytes


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth, at = bytearray(), 1, at + 1
    while True:
        c = data[at]
        if c == 0x5C:
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            at += 1
            if data[at : at + 2] == b"\r\n":
                at += 1
            elif data[at] not in b"\r\n":
                out += _ESCAPES.get(data[at], data[at : at + 1])
        else:
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                return bytes(out), at + 1
            out.append(c)
        at += 1


def value(data: bytes, at: int, refs: bool = True):
    """(the value at ``at``, where it ends); a Word for anything bare, None with the end of the data."""
    at = _SKIP.match(data, at).end()
    if at >= len(data):
        return None, at
    c = data[at : at + 1]
    if data[at : at + 2] == b"<<" or c == b"[":
        end, items = (b">>", []) if c == b"<" else (b"]", [])
        at += len(end)
        while True:
            at = _SKIP.match(data, at).end()
            if data[at : at + len(end)] == end:
                break
            if at >= len(data):
                raise ValueError("a list that does not end")
            item, at = value(data, at, refs)
            items.append(item)
        return (items if c == b"[" else dict(zip(items[::2], items[1::2], strict=True))), at + len(end)
    if c == b"(":
        return _literal(data, at)
    if c == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == b"/":
        found = _PLAIN.match(data, at + 1)
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), found[0] if found else b"")
        return Name(raw.decode("latin-1")), found.end() if found else at + 1
    if refs and (ref := _REF.match(data, at)):
        return Ref(int(ref[1]), int(ref[2])), ref.end()
    found = _PLAIN.match(data, at)
    if not found:
        return Word(c.decode("latin-1")), at + 1
    text = found[0]
    if _NUMBER.match(text):
        return (float(text) if b"." in text else int(text)), found.end()
    known = {b"true": True, b"false": False}
    return known.get(text, Word(text.decode("latin-1"))), found.end()


def _unpredict(data: bytes, columns: int, size: int) -> bytes:
    """Rows of PNG predictors as they were."""
    out, before = bytearray(), bytes(columns)
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for k in range(len(row)):
            left, up, corner = (row[k - size] if k >= size else 0), before[k], (before[k - size] if k >= size else 0)
            if kind == 4:
                guess = min((left, up, corner), key=lambda x: abs(left + up - corner - x))
            else:
                guess = (0, left, up, (left + up) // 2)[kind]
            row[k] = (row[k] + guess) & 255
        out += row
        before = bytes(row).ljust(columns, b"\0")
    return bytes(out)


class Pdf:
    """The objects of a file by their numbers."""

    def __init__(self, data: bytes):
        self.data, self.where, self.trailer, self.held = data, {}, {}, {}
        starts = re.findall(rb"startxref\s+(\d+)", data)
        if not data.lstrip().startswith(b"%PDF") or not starts:
            raise ValueError("no PDF file")
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            about = self._section(_SKIP.match(data, at).end())
            self.trailer = {**about, **self.trailer}
            todo += [about[k] for k in ("XRefStm", "Prev") if k in about]
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def _section(self, at: int) -> dict:
        if self.data[at : at + 4] == b"xref":
            at += 4
            while head := re.compile(rb"\s*(\d+)\s+(\d+)\s+").match(self.data, at):
                at = head.end()
                for number in range(int(head[1]), int(head[1]) + int(head[2])):
                    entry = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])").match(self.data, at)
                    if entry[3] == b"n":
                        self.where.setdefault(number, (int(entry[1]), None))
                    at = entry.end()
            word, at = value(self.data, at)
            if word != "trailer":
                raise ValueError("no trailer")
            return value(self.data, at)[0]
        held = self._object(at)
        if not isinstance(held, Stream):
            raise ValueError("no cross-reference")
        body, about = self.unpacked(held), held.about
        widths = [self.get(x) for x in about["W"]]
        edges = about.get("Index") or [0, about["Size"]]
        numbers = [n for a, c in zip(edges[::2], edges[1::2], strict=True) for n in range(a, a + c)]
        step = sum(widths)
        for k, number in enumerate(numbers):
            row, fields = body[k * step : (k + 1) * step], []
            for w in widths:
                fields.append(int.from_bytes(row[:w], "big"))
                row = row[w:]
            kind = fields[0] if widths[0] else 1
            if kind:
                self.where.setdefault(number, (fields[1], None if kind == 1 else fields[2]))
        return about

    def _object(self, at: int):
        for _ in range(3):  # number, generation, obj
            word, at = value(self.data, at, False)
        if word != "obj":
            raise ValueError("no object where one should be")
        found, at = value(self.data, at)
        if isinstance(found, dict) and (begin := re.compile(rb"\s*stream(\r\n|\n)").match(self.data, at)):
            size = self.get(found["Length"])
            return Stream(found, self.data[begin.end() : begin.end() + size])
        return found

    def get(self, x):
        """The object behind a reference, or ``x`` itself; null for what a file does not hold."""
        while isinstance(x, Ref):
            if x.number not in self.held:
                at, index = self.where.get(x.number, (None, None))
                if at is None:
                    self.held[x.number] = None
                elif index is None:
                    self.held[x.number] = self._object(at)
                else:
                    self._group(at)
                    self.held.setdefault(x.number, None)
            x = self.held[x.number]
        return None if isinstance(x, Word) and x == "null" else x

    def _group(self, number: int) -> None:
        holder = self.get(Ref(number, 0))
        body, first = self.unpacked(holder), self.get(holder.about["First"])
        heads = [int(x) for x in body[:first].split()]
        for n, at in zip(heads[::2], heads[1::2], strict=True):
            if self.where.get(n, (None, None))[0] == number:
                self.held.setdefault(n, value(body, first + at)[0])

    def unpacked(self, held: Stream) -> bytes:
        as_list = lambda x: x if isinstance(x, list) else [x]
        data, settings = held.raw, as_list(self.get(held.about.get("DecodeParms")))
        for k, kind in enumerate(as_list(self.get(held.about.get("Filter")) or [])):
            if self.get(kind) != "FlateDecode":
                raise ValueError(f"packed by {kind}")
            unpack = zlib.decompressobj()
            data = unpack.decompress(data, MOST_BYTES)
            if unpack.unconsumed_tail:
                raise ValueError("a stream that is too large")
            about = self.get(settings[k]) if k < len(settings) else None
            if about and about.get("Predictor", 1) >= 10:
                size = max(1, about.get("Colors", 1) * about.get("BitsPerComponent", 8) // 8)
                data = _unpredict(data, about.get("Columns", 1) * size, size)
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        todo, seen = [(self.get(self.trailer["Root"])["Pages"], {})], set()
        while todo:
            ref, above = todo.pop()
            if ref in seen:
                raise ValueError("a page within itself")
            seen.add(ref)
            node = self.get(ref)
            here = {**above, **{k: node[k] for k in ("Resources",) if k in node}}
            if "Kids" in node:
                todo += [(kid, here) for kid in reversed(self.get(node["Kids"]))]
            else:
                yield {**here, **node}


def _times(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _unicode_map(data: bytes) -> dict[int, str]:
    """Codes and their texts from a map to Unicode."""
    at, before, found = 0, [], {}
    number, text = lambda b: int.from_bytes(b, "big"), lambda b: b.decode("utf-16-be", "replace")
    while True:
        item, at = value(data, at, False)
        if item is None:
            return found
        if not isinstance(item, Word):
            before.append(item)
            continue
        if item == "endbfchar":
            found.update((number(a), text(b)) for a, b in zip(before[::2], before[1::2], strict=True))
        elif item == "endbfrange":
            for a, b, to in zip(before[::3], before[1::3], before[2::3], strict=True):
                for k, code in enumerate(range(number(a), number(b) + 1)):
                    found[code] = text(to[k]) if isinstance(to, list) else text(to[:-2] + (number(to[-2:]) + k).to_bytes(2, "big"))
        before = []


def _decoder(pdf: Pdf, font: dict) -> Callable[[bytes], str]:
    """How a font's bytes are read: a code is two bytes in a composite font, else one."""
    size = 2 if font.get("Subtype") == "Type0" else 1
    held = pdf.get(font.get("ToUnicode"))
    if isinstance(held, Stream):
        known = _unicode_map(pdf.unpacked(held))
    elif size == 2:
        known = {}
    else:
        known = {k: bytes([k]).decode("cp1252", "replace") for k in range(256)}
        encoding = pdf.get(font.get("Encoding"))
        code = 0
        for x in pdf.get(encoding.get("Differences", [])) if isinstance(encoding, dict) else []:
            if isinstance(x, Name):
                known[code] = x if len(x) == 1 else chr(int(x[3:7], 16)) if re.match("uni[0-9A-F]{4}$", x) else " " if x == "space" else known.get(code, "�")
                code += 1
            else:
                code = x
    return lambda b: "".join(known.get(int.from_bytes(b[k : k + size], "big"), "�") for k in range(0, len(b), size))


class _Page:
    """The lines of a page: spans that follow one another on one base line."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.lines, self.fonts = pdf, [], {}
        self.open = False

    def show(self, text: str, matrix, size: float) -> None:
        size *= hypot(matrix[2], matrix[3])
        if self.open:
            self.lines[-1][1][-1][0] += text
        elif self.lines and abs(self.lines[-1][0] - matrix[5]) < 0.3 * max(size, 0.1):
            self.lines[-1][1].append([text, size])
        else:
            self.lines.append((matrix[5], [[text, size]]))
        self.open = True

    def run(self, data: bytes, resources: dict, ctm=UNIT, inside: tuple = ()) -> None:
        get, at, stack, saved = self.pdf.get, 0, [], []
        font, size, lead, tm, line = None, 1.0, 0.0, UNIT, UNIT
        while True:
            item, at = value(data, at, False)
            if item is None:
                return
            if not isinstance(item, Word):
                stack.append(item)
                continue
            args, stack = stack, []
            if item == "q":
                saved.append((ctm, font, size, lead))
            elif item == "Q" and saved:
                ctm, font, size, lead = saved.pop()
            elif item == "cm":
                ctm = _times(args, ctm)
            elif item == "BT":
                tm = line = UNIT
                self.open = False
            elif item == "Tf":
                held = get(get(resources.get("Font") or {}).get(args[0]))
                if id(held) not in self.fonts:
                    self.fonts[id(held)] = _decoder(self.pdf, held or {})
                font, size = self.fonts[id(held)], args[1]
                self.open = False
            elif item == "TL":
                lead = args[0]
            elif item in ("Td", "TD", "T*", "'", '"', "Tm"):
                if item == "TD":
                    lead = -args[1]
                x, y = args[:2] if item in ("Td", "TD") else (0, -lead)
                tm = line = tuple(args) if item == "Tm" else _times((1, 0, 0, 1, x, y), line)
                self.open = False
            elif item == "Do":
                name = get(resources.get("XObject") or {}).get(args[0])
                form = get(name)
                if isinstance(form, Stream) and get(form.about.get("Subtype")) == "Form" and name not in inside:
                    self.run(self.pdf.unpacked(form), get(form.about.get("Resources")) or resources, _times(get(form.about.get("Matrix")) or UNIT, ctm), (*inside, name))
                    self.open = False
            elif item == "ID":
                at = re.compile(rb"[\s\S]*?[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").match(data, at).end()
            if item in ("Tj", "TJ", "'", '"') and font and args:
                parts = args[-1] if isinstance(args[-1], list) else [args[-1]]
                text = "".join(font(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x <= -GAP else "" for x in parts)
                self.show(text, _times(tm, ctm), size)


def read(content: bytes) -> tuple[list[tuple[int, int, str, float]], list]:
    """(lines (page_num, line_num, text, size), no tables) of a file; blank spans and lines are left out.

    A line is what is shown on one base line in a row; its text joins the spans by
    spaces and its size is their mean.
    """
    pdf, out = Pdf(content), []
    for number, page in enumerate(pdf.pages()):
        contents = pdf.get(page.get("Contents"))
        parts = [pdf.get(x) for x in contents] if isinstance(contents, list) else [contents] if contents else []
        made = _Page(pdf)
        made.run(b"\n".join(pdf.unpacked(x) for x in parts if x), pdf.get(page.get("Resources")) or {})
        spans = ([(t.strip(), s) for t, s in line if t.strip()] for _, line in made.lines)
        for k, line in enumerate(x for x in spans if x):
            out.append((number, k, " ".join(t for t, _ in line), sum(s for _, s in line) / len(line)))
    return out, []
