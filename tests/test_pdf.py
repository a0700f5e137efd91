"""PDF files made here, with tables or streams of references, read back by lines."""

import zlib

import pytest

from lodestar.sources import pages, pdf

CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <C0AC> <0002> <C5C5> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <00790079>] endbfrange"


def stream(body, extra=b"", pack=True):
    body = zlib.compress(body) if pack else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if pack else b"", extra, body)


def objects(contents, pack=True):
    """Numbered objects of a file with a page for each content; 1 root, 2 pages, 3 simple font, 4 composite font, 5 its map, 6 form."""
    n = len(contents)
    found = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> /XObject << /X 6 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n))),
        3: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /B /uni00E9] >> >>",
        4: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >>",
        5: stream(CMAP, pack=pack),
        6: stream(b"BT /F1 10 Tf (in a form) Tj ET /X Do", b"/Subtype /Form /Matrix [2 0 0 2 0 0]", pack),
    }
    for k, body in enumerate(contents):
        found[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        found[11 + 2 * k] = stream(body, pack=pack)
    return found


def with_table(contents, pack=True, extra=b""):
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects(contents, pack).items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    begin, size = len(out), max(at) + 1
    out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return bytes(out + b"trailer << /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (size, extra, begin))


def with_streams(contents):
    """Plain objects within an object stream, references in a stream with a predictor."""
    held = objects(contents)
    plain = {n: b for n, b in held.items() if b"endstream" not in b}
    out, rows = bytearray(b"%PDF-1.5\n"), {}
    heads, body = [], b""
    for k, (n, b) in enumerate(plain.items()):
        heads.append(b"%d %d" % (n, len(body)))
        body += b + b" "
        rows[n] = (2, 90, k)
    head = b" ".join(heads) + b" "
    held = {n: b for n, b in held.items() if n not in plain} | {90: stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)))}
    for n, b in held.items():
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    rows[91] = (1, len(out), 0)
    raw, before = b"", bytes(6)
    for n in range(92):
        kind, a, b = rows.get(n, (0, 0, 0))
        row = bytes([kind]) + a.to_bytes(4, "big") + bytes([b])
        raw += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
        before = row
    begin = len(out)
    out += b"91 0 obj\n%s\nendobj\n" % stream(raw, b"/Type /XRef /W [1 4 1] /Size 92 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>")
    return bytes(out + b"startxref\n%d\n%%%%EOF" % begin)


PAGES = [
    rb"BT /F1 24 Tf 50 700 Td (A title \(one\)) Tj /F1 12 Tf 0 -30 Td (left) Tj 100 0 Td (right) Tj 0 -14 TD [(wo) 20 (rd) -300 (gap)] TJ T* (n\145xt) Tj ET % a remark",
    b"q 2 0 0 2 0 0 cm BT /F2 6 Tf 1 0 0 1 10 50 Tm <00010002> Tj 0 -10 Td <001000110012 00200021> Tj ET Q BI /W 1 ID xx(( EI BT /F1 8 Tf 0 30 Td (AB) Tj ( ) Tj ET /X Do",
    b"",
]
LINES = [
    (0, 0, "B title (one)", 24.0), (0, 1, "left right", 12.0), (0, 2, "word gap", 12.0), (0, 3, "next", 12.0),
    (1, 0, "사업", 12.0), (1, 1, "ABCxyy", 12.0), (1, 2, "Bé", 8.0), (1, 3, "in a form", 20.0),
]


@pytest.mark.parametrize("made", [with_table(PAGES), with_table(PAGES, pack=False), with_streams(PAGES)])
def test_lines(made):
    lines, tables = pdf.read(made)
    assert [(p, k, t) for p, k, t, _ in lines] == [(p, k, t) for p, k, t, _ in LINES] and tables == []
    assert [s for *_, s in lines] == pytest.approx([s for *_, s in LINES])


def test_what_is_not_read_raises():
    good = with_table(PAGES)
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read(with_table(PAGES, extra=b"/Encrypt 9 0 R"))
    with pytest.raises(ValueError, match="no PDF"):
        pdf.read(b"plain text")
    with pytest.raises(ValueError, match="packed by"):
        pdf.read(good.replace(b"/FlateDecode", b"/LZWDecode  "))
    for cut in range(0, len(good), 97):
        with pytest.raises(Exception):  # noqa: B017  any error, never a hang
            pdf.read(good[:cut])


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(with_table(PAGES))
    (tmp_path / "c.pdf").write_bytes(with_streams(PAGES[:1]))
    (tmp_path / "broken.pdf").write_bytes(with_table(PAGES)[:700])
    states = {r.doc_name: r.status for r in pages.parse_files(spark, str(tmp_path), pdf.read).collect()}
    assert states.pop("broken").startswith("failed") and states == {"a b": "ok", "c": "ok"}
    chunks = {r.chunk_id: r for r in pages.page_chunks(*pages.read_files(spark, str(tmp_path), pdf.read)).collect()}
    assert set(chunks) == {"a b_p000", "a b_p001", "c_p000"}
    assert chunks["c_p000"].text == "## B title (one)\nleft right\nword gap\nnext" and chunks["c_p000"].content_type == "mixed"
