"""Compound files that the test writes itself."""

import random
import struct
import zlib

import pytest

from lodestar.sources import compound, hwp

END, FREE, TABLE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFF


def write(tree, size=512, small=64, cutoff=4096, shuffle=None):
    """A compound file of {name: bytes or {name: bytes}}; sectors in an order that ``shuffle`` mixes."""
    entries, mini = [["Root Entry", 5, NONE, NONE, NONE, END, 0]], b""
    links, blocks = [], []

    def chain(data, step, table, put):
        first = len(table)
        n = -(-len(data) // step)
        for k in range(n):
            table.append(first + k + 1 if k + 1 < n else END)
            put(data[k * step : (k + 1) * step].ljust(step, b"\0"))
        return first if n else END

    small_links, small_blocks = [], []

    def add(name, value):
        at = len(entries)
        entries.append([name, 1 if isinstance(value, dict) else 2, NONE, NONE, NONE, 0, 0])
        if isinstance(value, dict):
            entries[at][4] = level(value)
        else:
            entries[at][6] = len(value)
            if len(value) < cutoff:
                entries[at][5] = chain(value, small, small_links, small_blocks.append)
            else:
                entries[at][5] = chain(value, size, links, blocks.append)
        return at

    def level(names):
        """Siblings as a list to the right, which is a tree too."""
        made = [add(n, v) for n, v in names.items()]
        for a, b in zip(made, made[1:], strict=False):
            entries[a][3] = b
        return made[0] if made else NONE

    entries[0][4] = level(tree)
    mini = b"".join(small_blocks)
    entries[0][5], entries[0][6] = chain(mini, size, links, blocks.append), len(mini)
    raw = b""
    for name, kind, left, right, child, first, n in entries:
        units = (name + "\0").encode("utf-16-le")
        raw += units.ljust(64, b"\0") + struct.pack("<HBB3I", len(units), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", first, n)
    directory = chain(raw, size, links, blocks.append)
    small_table = struct.pack(f"<{len(small_links)}I", *small_links)
    small_first = chain(small_table.ljust(-(-len(small_table) // size) * size, b"\xff"), size, links, blocks.append)
    per = size // 4
    tables = 1
    while tables * per < len(links) + tables + max(0, -(-(tables - 109) // (per - 1))):
        tables += 1
    more = max(0, -(-(tables - 109) // (per - 1)))
    own = list(range(len(links), len(links) + tables))
    extra = list(range(len(links) + tables, len(links) + tables + more))
    whole = links + [TABLE] * tables + [0xFFFFFFFC] * more
    order = list(range(len(whole)))
    if shuffle is not None:
        random.Random(shuffle).shuffle(order)
    new = lambda n: order[n] if n < len(order) else n
    table = [FREE] * (tables * per)
    for a, b in enumerate(whole):
        table[order[a]] = new(b)
    body = [b""] * len(whole)
    for a, block in enumerate(blocks):
        body[order[a]] = block
    fixed = lambda n: new(n) if n < END - 2 else n
    # entries name sectors in the new order; small chains keep their numbers
    raw2 = b""
    for name, kind, left, right, child, first, n in entries:
        big = kind == 5 or (kind == 2 and n >= cutoff)
        units = (name + "\0").encode("utf-16-le")
        raw2 += units.ljust(64, b"\0") + struct.pack("<HBB3I", len(units), kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", fixed(first) if big else first, n)
    at = directory
    for k in range(0, len(raw2), size):
        body[order[at + k // size]] = raw2[k : k + size].ljust(size, b"\0")
    for k, n in enumerate(own):
        body[order[n]] = struct.pack(f"<{per}I", *table[k * per : (k + 1) * per])
    listed = [order[n] for n in own]
    for k, n in enumerate(extra):
        some = listed[109 + k * (per - 1) : 109 + (k + 1) * (per - 1)]
        some += [FREE] * (per - 1 - len(some)) + [order[extra[k + 1]] if k + 1 < len(extra) else END]
        body[order[n]] = struct.pack(f"<{per}I", *some)
    first_109 = (listed[:109] + [FREE] * 109)[:109]
    shift = lambda x: x.bit_length() - 1
    head = compound.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, shift(size), shift(small)) + b"\0" * 6
    head += struct.pack("<3I", 0, tables, order[directory]) + b"\0" * 4 + struct.pack("<5I", cutoff, fixed(small_first), -(-len(small_table) // size), order[extra[0]] if extra else END, more)
    head += struct.pack("<109I", *first_109)
    return head.ljust(size, b"\0") + b"".join(body)


@pytest.mark.parametrize(("size", "shuffle"), [(512, None), (512, 3), (4096, 5), (512, 7)])
def test_streams(size, shuffle):
    rng = random.Random(1)
    tree = {"A": b"", "small": rng.randbytes(100), "edge": rng.randbytes(4095), "big": rng.randbytes(4096), "dir": {"x": rng.randbytes(30_000), "deep": {"y": b"1"}}, "한글": b"z" * 64}
    held = compound.Compound(write(tree, size=size, shuffle=shuffle))
    flat = {("A",): b"", ("small",): tree["small"], ("edge",): tree["edge"], ("big",): tree["big"], ("dir", "x"): tree["dir"]["x"], ("dir", "deep", "y"): b"1", ("한글",): b"z" * 64}
    assert {p: held.read(*p) for p in held.paths} == flat
    with pytest.raises(KeyError):
        held.read("none")


def test_more_tables_than_the_header_lists():
    data = random.Random(2).randbytes(7_600_000)
    held = compound.Compound(write({"big": data, "s": b"ab"}, shuffle=1))
    assert held.read("big") == data and held.read("s") == b"ab"


def test_damaged_files():
    good = write({"big": bytes(9000), "s": b"ab"})
    for bad in (b"", b"text", good[:300], good[:1024], good[:512] + b"\0" * 512 + good[1024:2000]):
        with pytest.raises(compound.Damaged):
            compound.Compound(bad).read("big")
    rng = random.Random(3)
    for _ in range(300):  # any bytes end with an answer or an error, never in a loop
        broken = bytearray(good)
        for _ in range(6):
            broken[rng.randrange(30, len(broken))] = rng.randrange(256)
        try:
            held = compound.Compound(bytes(broken))
            for p in held.paths:
                held.read(*p)
        except (ValueError, KeyError):
            pass


def paragraph(text):
    data = text.encode("utf-16-le")
    size = min(len(data), 0xFFF)
    return (67 | size << 20).to_bytes(4, "little") + (len(data).to_bytes(4, "little") if size == 0xFFF else b"") + data


@pytest.mark.parametrize("packed", [True, False])
def test_text_of_twelve_sections(spark, tmp_path, packed):
    def body(text):
        data = paragraph(text)
        deflate = zlib.compressobj(wbits=-15)
        return deflate.compress(data) + deflate.flush() if packed else data

    head = bytes(36) + bytes([packed]) + bytes(219)
    sections = {f"Section{i}": body(f"section {i} " + "가나다 " * (900 if i == 4 else 30)) for i in (11, 3, 0, 10, 1, 2, 4, 5, 6, 7, 8, 9)}
    content = write({"FileHeader": head, "BodyText": sections, "Other": {"Section0": b"no"}}, shuffle=4)
    lines = hwp.file_text(content).split("\n")
    assert [x.split(" 가")[0] for x in lines] == [f"section {i}" for i in range(12)]
    assert hwp.file_text(b"plain") == ""
    (tmp_path / "기관_사업.hwp").write_bytes(content)
    (tmp_path / "기관_깨짐.hwp").write_bytes(content[:2000])
    got = {r.filename: r for r in hwp.ingest_directory(spark, str(tmp_path)).collect()}
    assert got["기관_사업.hwp"].status == "ok" and got["기관_사업.hwp"].text.startswith("section 0") and got["기관_깨짐.hwp"].status == "failed: Damaged"
    rows = [("d", name, data, packed) for name, data in sections.items()]
    text = hwp.decode_sections(spark.createDataFrame(rows, "doc_id string, section string, data binary, compressed boolean")).first().text
    assert [x.split(" 가")[0] for x in text.split("\n")] == [f"section {i}" for i in range(12)]
