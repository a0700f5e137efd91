"""Language identification by a mixture of languages in each document.

Words are drawn from a mixture of learned languages. A word's likelihood under a
language is the product of its hashed byte-trigram probabilities;
expectation-maximisation estimates each document's language proportions, and the
language set is chosen by likelihood less a penalty for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import tree_sum, tune
from lodestar.llm.textkernels import Words, chunks, crc_remainder

#: Cells of the trigram table: fixed, so a model takes CELLS * 4 bytes a language.
CELLS = 1 << 16
#: Bound of the languages that are learned, as every task holds their table.
MOST_LANGUAGES = 1000
#: Bytes of words whose trigrams are looked up at a time.
BLOCK = 1 << 19
FOLDS, HELD = 5, 0
SMOOTH = 0.5
ROUNDS = 12
#: Cost of one more language, in units of half the logarithm of the number of words.
PENALTY = 4.0
UNKNOWN = "und"


def trigram_cells(low: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The cell of the trigram around each byte of words that begin at ``begin``, one behind the other; their ends count as one symbol."""
    b = low.astype(np.uint32)
    left, right = np.zeros_like(b), np.zeros_like(b)
    left[1:], right[:-1] = b[:-1], b[1:]
    left[begin] = 0
    right[begin[1:] - 1] = 0
    h = (left * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def word_bytes(words: Words, pick: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, begins) of lots of the words (``pick``), in order, of about BLOCK bytes or of one word."""
    start, end = (words.start, words.end) if pick is None else (words.start[pick], words.end[pick])
    edge = np.concatenate(([0], np.cumsum(end - start)))
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + BLOCK, side="right")) - 1)
        at = np.repeat(start[a:b] - edge[a:b], end[a:b] - start[a:b]) + np.arange(edge[a], edge[b])
        yield a, b, words.low[at], edge[a:b] - edge[a]
        a = b


def likelihoods(words: Words, pick: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihood of the picked words under each language [n, L]; a word of over BLOCK bytes is added up in parts."""
    out = np.zeros((len(pick), table.shape[1]))
    for a, b, low, begin in word_bytes(words, pick):
        cells = trigram_cells(low, begin)
        if b == a + 1:
            for x in range(0, len(cells), BLOCK):
                out[a] += table[cells[x : x + BLOCK]].sum(axis=0, dtype=np.float64)
        else:
            out[a:b] = np.add.reduceat(table[cells], begin, axis=0, dtype=np.float64)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        ids, texts, langs = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        use = crc_remainder(ids, FOLDS) != HELD
        use &= np.array([x is not None for x in langs], dtype=bool)
        kept = np.flatnonzero(use)
        if not len(kept):
            continue
        order = sorted(kept, key=lambda i: langs[i])
        names = np.array([langs[i] for i in order], dtype=object)
        for at, data, offsets in chunks(texts.take(pa.array(order))):
            words = Words(data, offsets)
            some = names[at : at + words.rows]
            edges = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                table = tables.setdefault(some[a], np.zeros(CELLS, dtype=np.int64))
                of = np.arange(*np.searchsorted(words.row, [a, b]))
                for _, _, low, begin in word_bytes(words, of):
                    table += np.bincount(trigram_cells(low, begin), minlength=CELLS)
    names = sorted(tables)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([tables[x].tobytes() for x in names], pa.binary())], ["lang", "counts"]
    )


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS, dtype=np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, dtype=np.int64)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [CELLS, languages]) of all training rows.

    Each task counts into one table a language; tables are added in a tree. What
    comes to the driver is one table of ``CELLS`` numbers a language. More than
    ``MOST_LANGUAGES`` different values to learn raise before anything is counted.
    """
    tune(docs.sparkSession)
    some = docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count()
    if some > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {lang_col}: a model takes {CELLS * 4} bytes a language")
    parts = docs.select(id_col, text_col, lang_col).mapInArrow(_count, "lang string, counts binary")
    rows = tree_sum(parts, _add, "lang string, counts binary", "lang").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    names = [r["lang"] for r in rows]
    table = np.zeros((CELLS, len(names)), dtype=np.float32)
    for k, r in enumerate(rows):
        c = np.frombuffer(r["counts"], dtype=np.int64) + SMOOTH
        table[:, k] = np.log(c / c.sum())
    return names, table


def proportions(loglik: np.ndarray, starts: np.ndarray, allowed: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM over words [n, L] of documents beginning at ``starts``; (proportions [d, L], log-likelihood [d]).

    ``allowed`` [d, L] holds the languages of each document's set, ``times`` [n] how
    often a word occurs (once by default).
    """
    counts = np.diff(np.append(starts, len(loglik)))
    times = np.ones(len(loglik)) if times is None else times
    total = np.add.reduceat(times, starts)
    top = loglik.max(axis=1, keepdims=True)
    like = np.exp(loglik - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * np.repeat(share, counts, axis=0)
        joint *= (times / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    word = np.log(np.maximum((like * np.repeat(share, counts, axis=0)).sum(axis=1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(word * times, starts)


def choose(loglik: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [d, L] within the chosen set, size of the set [d]).

    Languages enter by their proportion under all languages. The set grows while
    a further language raises the likelihood by more than its penalty.
    """
    d, languages = len(starts), loglik.shape[1]
    counts = np.diff(np.append(starts, len(loglik)))
    times = np.ones(len(loglik)) if times is None else times
    total = np.add.reduceat(times, starts) if d else np.zeros(0)
    full, _ = proportions(loglik, starts, np.ones((d, languages)), times)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(languages)[None, :].repeat(d, 0), axis=1)
    best = np.zeros((d, languages))
    size = np.zeros(d, dtype=np.int64)
    score = np.full(d, -np.inf)
    live = np.arange(d)
    for k in range(1, languages + 1):
        if not len(live):
            break
        part = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[live], counts[live], strict=True)]) if len(live) < d else slice(None)
        begin = np.concatenate(([0], np.cumsum(counts[live])[:-1]))
        share, ll = proportions(loglik[part], begin, (rank[live] < k).astype(np.float64), times[part])
        value = ll - PENALTY * k * 0.5 * np.log(total[live] + 1.0)
        better = value > score[live]
        won = live[better]
        best[won], size[won], score[won] = share[better], k, value[better]
        # a language with next to no share cannot pay for itself
        live = won[full[won, order[won, min(k, languages - 1)]] > 0.5 / total[won]] if k < languages else won[:0]
    return best, size


def _has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    ascii_letter = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~ascii_letter):
        text = texts[int(i)].as_py()
        ascii_letter[i] = text is not None and any(c.isalpha() for c in text)
    return ascii_letter


def predictor(names: list[str], model):
    """A mapInArrow function: (id, text) -> id, held_out, lang_pred, score, n_languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            pred, score, size = np.zeros(n, dtype=np.int64) - 1, np.zeros(n), np.zeros(n, dtype=np.int64)
            if names:
                for at, data, offsets in chunks(texts, 1 << 19):
                    words = Words(data, offsets)
                    if not len(words):
                        continue
                    # a document's equal words count as one with its times
                    h = words.hashes()
                    order = np.lexsort((h, words.row))
                    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])))
                    pick, times = order[new], np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.float64)
                    present = np.flatnonzero(words.per_row())
                    starts = np.searchsorted(words.row[pick], present)
                    share, k = choose(likelihoods(words, pick, table), starts, times)
                    pred[at + present], score[at + present], size[at + present] = share.argmax(axis=1), share.max(axis=1), k
            lettered = _has_letter(texts)
            known = lettered & (pred >= 0)
            label = [names[p] if ok else UNKNOWN for p, ok in zip(pred, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(crc_remainder(batch.column(0).to_pylist(), FOLDS) == HELD), pa.array(label, pa.string()),
                    pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(np.where(known, size, 0).astype(np.int32)),
                ],
                ["id", "held_out", "lang_pred", "score", "n_languages"],
            )

    return run


def identify(docs: DataFrame, train_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score, n_languages).

    Learned from text and non-null languages of the rows of ``train_on`` (``docs``
    itself by default) whose crc32(id as text) mod 5 is not 0. ``score`` is the
    share of the document's words in the predicted language, ``n_languages`` the
    size of the chosen set. Very long texts are scored whole, a block of bytes at a
    time; what is held is a row of likelihoods for each of their different words.
    A text that is null or has no letter is ``und`` with
    score 0, and so is every text if nothing was learned. Ties go to the
    language that sorts first. Repeated rows and null ids are rows of their own;
    extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    names, table = train(docs if train_on is None else train_on, id_col, text_col, lang_col)
    model = spark.sparkContext.broadcast(table)  # CELLS * 4 bytes a language
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(predictor(names, model), f"id {kind}, held_out boolean, lang_pred string, score double, n_languages int")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is found.

    Only rows go that are ``und``: without a text or without a letter. A document
    in several languages stays, however they share its words. If nothing was
    learned, because no row names a language, every row stays. Null ids, repeated
    rows and very long texts are rows like others; an empty table gives an empty
    result; columns may have any names. No row moves between tasks.
    """
    spark = docs.sparkSession
    names, table = train(docs, id_col, text_col, lang_col)
    if not names:
        return docs
    model = spark.sparkContext.broadcast(table)  # CELLS * 4 bytes a language
    predict, at = predictor(names, model), (docs.columns.index(id_col), docs.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(predict(iter([pa.RecordBatch.from_arrays([batch.column(i) for i in at], ["id", "text"])])))
            ok = np.array(found.column(2).to_pylist(), dtype=object) != UNKNOWN
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
