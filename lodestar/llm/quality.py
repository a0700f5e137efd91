"""A quality classifier: hashed word n-grams and logistic regression by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import take_by_hash, tune
from lodestar.llm.textkernels import Words, chunks, crc_remainder, mix

#: Weights of the model: fixed, so it takes BUCKETS * 4 bytes.
BUCKETS = 1 << 18
#: Bound of the labelled rows that are fitted, taken by a hash of their id.
MAX_LABELLED = 20_000
FOLDS, HELD, THRESHOLD = 5, 0, 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 1.0, 3


#: Byte classes of a word's shape: lower and non-ASCII a, upper A, digit 9, others themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[128:] = ord("a")


def shapes(words: Words) -> np.ndarray:
    """Hashes of the words' shapes: runs of one byte class count once."""
    c = _CLASS[words.data]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = c[1:] != c[:-1]
    keep[words.start] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    inner = Words.__new__(Words)
    inner.start, inner.end = at[words.start], at[words.end]
    return inner.hashes(c[keep])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows and buckets of every n-gram: words, word pairs, shapes and shape pairs."""
    words = Words(data, offsets)
    found = []
    if len(words):
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        for salt, h in ((1, words.hashes()), (2, shapes(words))):
            s = np.uint64(salt)
            found.append((words.row, (mix(h + s) >> shift).astype(np.int64)))
            same = words.row[1:] == words.row[:-1]
            pair = mix(h[:-1] * np.uint64(3) + mix(h[1:] + s))[same]
            found.append((words.row[1:][same], (pair >> shift).astype(np.int64)))
    return words, found


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, index, value = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], []
        for _, data, offsets in chunks(batch.column(1)):
            words, found = features(data, offsets)
            counts = np.maximum(words.per_row(), 1)
            if found:
                keys = np.concatenate([r * BUCKETS + b for r, b in found])
                keys, times = np.unique(keys, return_counts=True)
                row, bucket = keys // BUCKETS, keys % BUCKETS
                share = (times / counts[row]).astype(np.float32)
                edges = np.searchsorted(row, np.arange(words.rows + 1))
            else:
                bucket, share, edges = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros(words.rows + 1, dtype=np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                index.append(bucket[a:b].astype(np.int32).tobytes())
                value.append(share[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(labels, pa.int32()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["id", "label", "at", "share"])


#: The features of a text are shares of its words, scaled so that one matters.
SCALE = 12.0


def fit_ftrl(examples: Iterator[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over (buckets, values, label); z and n change in place.

    The bias is the last cell, without L1.
    """
    bias = len(z) - 1
    for at, x, y in examples:
        at, x = np.append(at, bias), np.append(x, 1.0)
        zi, ni = z[at], n[at]
        root = np.sqrt(ni)
        w = -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        w[-1] = -zi[-1] / ((BETA + root[-1]) / ALPHA)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(ni + g * g) - root) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0.0
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w.astype(np.float32)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("turn", kind="stable")
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32) * SCALE, int(y)) for a, v, y in zip(pdf["at"], pdf["share"], pdf["label"], strict=True)]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        fit_ftrl((rows[i] for i in order), z, n)
    return pd.DataFrame({"w": [weights_of(z, n).tobytes()], "rows": [len(rows)]})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the labelled rows outside the held-out fold, at most ``MAX_LABELLED`` of them.

    The bound is by a hash of the id, so it is the same rows at every run; an id
    with more than one label counts with the smallest, and one with more than one
    text with the text whose features have the smallest hash. The ids and labels
    of the sample are at most MAX_LABELLED rows, so they are broadcast; features
    are made where the texts are, an id's are combined there, and one task fits
    at most MAX_LABELLED rows of them.
    """
    spark = docs.sparkSession
    tune(spark)
    marked = labels.select(F.col(id_col).alias("marked"), F.col(label_col).alias("label"))
    marked = marked.where(F.col("label").isNotNull() & F.col("marked").isNotNull() & (F.pmod(F.crc32(F.col("marked").cast("string")), F.lit(FOLDS)) != HELD))
    marked = marked.groupBy("marked").agg(F.min("label").cast("int").alias("label"))
    sample = take_by_hash(marked, "marked", MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("marked")).select("id", "text", "label")
    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(_examples, f"id {kind}, label int, at binary, share binary")
    one = F.min_by(F.struct("label", "at", "share"), F.struct(F.xxhash64("at", "share"), "at", "share"))
    made = made.groupBy("id").agg(one.alias("x")).select(F.lit(1).alias("fit"), F.xxhash64("id").alias("turn"), "x.*")
    fitted = made.groupBy("fit").applyInPandas(_fit, "w binary, rows long").collect()
    return np.frombuffer(fitted[0]["w"], np.float32) if fitted else np.zeros(BUCKETS + 1, dtype=np.float32)


def scorer(model):
    """A mapInArrow function: (id, text) -> id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for at, data, offsets in chunks(batch.column(1)):
                words, found = features(data, offsets)
                dot = np.zeros(words.rows)
                for row, bucket in found:
                    dot += np.bincount(row, weights=w[bucket], minlength=words.rows)
                total[at : at + words.rows] = dot * SCALE / np.maximum(words.per_row(), 1)
            p = 1.0 / (1.0 + np.exp(-np.clip(total + w[-1], -35, 35)))
            held = crc_remainder(batch.column(0).to_pylist(), FOLDS) == HELD
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    ``score`` is the probability of label 1 from the text alone. A null, empty or
    wordless text has the score of the bias. Without any label, scores are 0.5.
    Repeated rows and null ids are rows of their own; extra columns are ignored;
    an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, id_col, text_col))  # BUCKETS * 4 bytes
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(scorer(model), f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
