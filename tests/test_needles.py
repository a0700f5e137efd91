"""The automaton against plain searches."""

import random

import numpy as np
import pytest

from lodestar.functions import needles


def plain(text, needle):
    if text is None or needle is None:
        return []
    if not needle:
        return [0]
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + len(needle))
    return out


@pytest.mark.parametrize(("lane", "chunk", "table"), [(1024, 1 << 22, 64 << 20), (3, 50, 64 << 20), (8, 200, 20_000)])
def test_matches(spark, monkeypatch, lane, chunk, table):
    for name, x in (("LANE", lane), ("CHUNK", chunk), ("TABLE_BYTES", table), ("OUT", 7)):
        monkeypatch.setattr(needles, name, x)
    rng = random.Random(lane)
    letters = "ab가é\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(40)] + [None, "", "aaaaaaa", "가" * 60]
    asked = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"aa", "aaa", "가가가", "", "ab" * 6}) + [None, "aa"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc long, text string, other string").repartition(3)
    sought = spark.createDataFrame(list(enumerate(asked)), "number int, needle string")
    got = {}
    for r in needles.matches(rows, "text", sought, "needle", pad=4).collect():
        got.setdefault((r.doc, r.number), []).append(r.start)
        low = max(0, r.start - 4)
        assert r.other == "x" and r.at == r.start - low and r.around == texts[r.doc][low : r.start + len(r.needle) + 4]
    want = {(i, j): plain(t, n) for i, t in enumerate(texts) for j, n in enumerate(asked)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    first = {(r.doc, r.number): r.start for r in needles.matches(rows, "text", sought, "needle", first=True).collect()}
    assert first == {k: v[0] for k, v in want.items() if v}


def test_no_needles(spark):
    rows = spark.createDataFrame([(1, "a")], "doc long, text string")
    assert needles.matches(rows, "text", spark.createDataFrame([(None,)], "needle string"), "needle").count() == 0
    with pytest.raises(ValueError):
        needles.matches(rows, "text", spark.createDataFrame([(1, "a")], "doc long, needle string"), "needle")


def test_steps_do_not_depend_on_the_needles(monkeypatch):
    """A text is read once, whatever is looked for."""
    data = np.frombuffer(b"some words of a text " * 200, dtype=np.uint8)
    steps = []
    take = np.flatnonzero

    def counted(x):
        steps.append(len(x))
        return take(x)

    for n in (1, 500):
        automaton = needles.Automaton([f"w{k}".encode() for k in range(n)])
        steps.clear()
        monkeypatch.setattr(needles.np, "flatnonzero", counted)
        automaton.hits(data, np.array([0, len(data)]))
        monkeypatch.undo()
        assert len(data) <= sum(steps) < 1.2 * len(data)
