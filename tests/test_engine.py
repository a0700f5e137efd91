"""The serving surface from end to end."""

import numpy as np
import pytest

from lodestar.engine import Engine
from lodestar.sources import pages


def encoder(texts):
    v = np.array([[float(t.count(w)) for w in ("battery", "motor", "sensor")] for t in texts]) + 1e-3
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("with_vectors", [True, False])
def test_engine(spark, tmp_path, with_vectors):
    e = Engine(spark, str(tmp_path / "store"), encoder if with_vectors else None)
    asked = spark.createDataFrame([(1, "battery voltage"), (2, "motor control")], "qid long, question string")
    assert e.health()["status"] == "empty"
    with pytest.raises(LookupError):
        e.query(asked)
    assert e.ingest(spark.createDataFrame([("a", "battery pack voltage"), ("b", "motor control logic")], "doc_id string, text string")) == 2
    assert e.ingest(spark.createDataFrame([("c", "sensor calibration"), ("a", "battery voltage 400V")], "doc_id string, text string")) == 2
    assert e.health() == {"status": "ok", "generation": 2, "chunks": 3, "vectors": with_vectors}
    best = {r.qid: r for r in e.query(asked, 1).collect()}
    assert best[1].text == "battery voltage 400V" and best[2].doc_name == "b"
    assert best[1].mode == ("hybrid" if with_vectors else "bm25_only")
    assert all(r.answer.startswith("[") for r in e.answer(asked).collect())
    with pytest.raises(ValueError):
        e.ingest(spark.createDataFrame([("x", " ")], "doc_id string, text string"))
    nothing = spark.createDataFrame([(9, "?!")], "qid long, question string")
    if not with_vectors:
        assert [r.answer for r in e.answer(nothing).collect()] == ["관련 문서를 찾을 수 없습니다."]


def test_a_reader_between_writes_sees_the_last_generation(spark, tmp_path, monkeypatch):
    from lodestar.sources import stores

    e = Engine(spark, str(tmp_path / "store"))
    e.ingest(spark.createDataFrame([("a", "battery pack")], "doc_id string, text string"))
    seen = []

    def look_then_fail(*args):
        seen.append(Engine(spark, str(tmp_path / "store")).health())
        raise OSError("the disk is full")

    monkeypatch.setattr(stores, "write_index", look_then_fail)
    with pytest.raises(OSError):
        e.ingest(spark.createDataFrame([("b", "motor")], "doc_id string, text string"))
    monkeypatch.undo()
    asked = spark.createDataFrame([(1, "battery")], "qid long, question string")
    assert seen[0]["generation"] == 1 and e.health()["chunks"] == 1 and e.query(asked).count() == 1
    e.ingest(spark.createDataFrame([("b", "motor")], "doc_id string, text string"))
    assert e.health() == {"status": "ok", "generation": 2, "chunks": 2, "vectors": False}


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("with_vectors", [True, False])
def test_a_store_of_many_segments_answers_as_one_that_is_rebuilt(spark, tmp_path, monkeypatch, with_vectors):
    """Documents one by one, some again, through merges: the same rows as all at once, and no ingest but a merge writes more than its own."""
    from lodestar import engine
    from lodestar.plans import lineage

    monkeypatch.setattr(engine, "FAN", 3)
    words = ["battery", "motor", "sensor", "voltage", "logic", "pack", "control"]
    texts = {f"d{i}": " ".join(words[(i * j) % 7] for j in range(1, 4 + i % 5)) for i in range(8)}
    store = Engine(spark, str(tmp_path / "store"), encoder if with_vectors else None)
    before = lineage.held_tables()
    for name, text in [*((n, "old " + t) for n, t in list(texts.items())[:3]), *texts.items()]:
        store.ingest(spark.createDataFrame([(name, text)], "doc_id string, text string"))
    assert lineage.held_tables() == before
    state = store._state()
    assert state.generation == 11 and len(state.live) < 6 and store.health()["chunks"] == 8
    whole = Engine(spark, str(tmp_path / "whole"), encoder if with_vectors else None)
    whole.ingest(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    asked = spark.createDataFrame([(1, "battery voltage"), (2, "motor control old"), (3, "pack pack logic")], "qid long, question string")
    rows = lambda e: sorted(map(tuple, e.query(asked, 3).collect()))
    assert rows(store) == rows(whole)


def test_one_document_more_writes_one_segment(spark, tmp_path):
    """To a store of 20 and of 800 documents: the bytes are those of the document."""
    written = []
    for n in (20, 800):
        path = tmp_path / f"store{n}"
        e = Engine(spark, str(path))
        e.ingest(spark.createDataFrame([(f"d{i}", f"battery number {i} of the pack {i * 7}") for i in range(n)], "doc_id string, text string"))
        held = size_of(path)
        e.ingest(spark.createDataFrame([("d3", "a motor instead")], "doc_id string, text string"))
        written.append(size_of(path) - held)
        assert e.health()["chunks"] == n
    assert written[1] < 1.1 * written[0]


def test_requests(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from lodestar import service

    e = Engine(spark, str(tmp_path / "store"))
    ask = lambda path, body=None, method="POST": service.handle(e, method, path, b"" if body is None else json.dumps(body).encode())
    assert ask("/health", method="GET")[1]["status"] == "empty" and ask("/health")[0] == 405 and ask("/other")[0] == 404
    assert ask("/query", {"question": "tide"})[0] == 404
    assert ask("/ingest", {"documents": [{"name": "a.exe", "text": "x"}]})[0] == 400
    for bad in ({}, {"documents": []}, {"documents": [{"name": "a.txt"}]}, {"documents": [{"name": "a.txt", "text": " "}]}):
        assert ask("/ingest", bad)[0] == 422
    assert service.handle(e, "POST", "/ingest", b"{")[0] == 422
    assert ask("/ingest", {"documents": [{"name": "a.txt", "text": "tide tables"}, {"name": "b.md", "text": "harvest dates"}]}) == (200, {"chunks": 2})
    from lodestar.plans import lineage

    before = lineage.held_tables()
    assert ask("/query", {"question": "harvest"})[1]["results"][0]["doc_name"] == "b" and lineage.held_tables() == before
    assert ask("/query", {"question": " "})[0] == 422 and ask("/query", {"question": "tide", "k": 0})[0] == 422
    server = service.serve(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    with urllib.request.urlopen(urllib.request.Request(f"{url}/query", json.dumps({"question": "tide", "k": 1}).encode())) as r:
        found = json.load(r)
    assert found["results"][0]["doc_name"] == "a" and found["answer"].startswith("[a")
    with pytest.raises(urllib.error.HTTPError, match="404"):
        urllib.request.urlopen(f"{url}/nothing")
    server.shutdown()


def test_files(spark, tmp_path):
    (tmp_path / "manual 1.pdf").write_bytes(b"Title|body")
    (tmp_path / "broken.pdf").write_bytes(b"no bar")

    def parser(content):
        a, b = content.decode().split("|")
        return [(0, 0, a, 20.0), (0, 1, b, 10.0)], [(0, 0, [["x", "y"], ["1", None]])]

    got = pages.page_chunks(*pages.read_files(spark, str(tmp_path), parser)).collect()
    assert [(r.chunk_id, r.has_table, r.text.split("\n")[0]) for r in got] == [("manual 1_p000", True, "## Title")]
    states = {r.doc_name: r.status for r in pages.parse_files(spark, str(tmp_path), parser).collect()}
    assert states == {"manual 1": "ok", "broken": "failed: ValueError"}
