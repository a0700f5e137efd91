"""The serving surface: ingest documents, answer batches of questions, report health."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import tokens
from lodestar.operators import answers, dense, ranking, segments
from lodestar.operators.chunking import chunk
from lodestar.plans.lineage import owned
from lodestar.sources import stores

Encoder = Callable[[list[str]], np.ndarray]
#: Segments of about one size that are merged into one.
FAN = 8
COLUMNS = ["chunk_id", "doc_name", "page_num", "text"]


@dataclass(frozen=True)
class State:
    """What a generation consists of: its segments with how many chunks each holds, and the folders that say which are gone."""

    generation: int
    live: dict[int, int]
    gone: tuple[int, ...]


class Engine:
    """Segments of chunks, vectors and postings under one folder.

    An ingest writes one new segment, of its own documents alone, and last the folder
    ``current-<n>``, which names the segments that count and whose success
    marker makes it the newest. Nothing that exists is overwritten, so readers,
    and an ingest that fails, see the generation before. A document that comes
    again replaces its chunks: the new segment says which chunks of older ones
    are gone, and what they had counted. Term statistics are sums over segments less
    those. ``FAN`` segments of about one size are merged into one, without what
    is gone, so a chunk is rewritten as often as the logarithm of the store.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: Encoder | None = None, size: int = 1000, overlap: int = 150):
        self.spark, self.path, self.encoder, self.size, self.overlap = spark, path.rstrip("/"), encoder, size, overlap

    def _state(self) -> State | None:
        """The newest complete generation, or None."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/current-*/_SUCCESS")) or []
        n = max((int(x.getPath().getParent().getName().removeprefix("current-")) for x in found), default=0)
        if not n:
            return None
        said = json.loads(self.spark.read.text(f"{self.path}/current-{n}").first()[0])
        return State(n, {int(k): v for k, v in said["live"].items()}, tuple(said["gone"]))

    def _folder(self, segment: int) -> str:
        return f"{self.path}/segment={segment}"

    def _gone(self, state: State) -> DataFrame | None:
        """(segment, chunk_id, term, tf) of the chunks that no longer count."""
        if not state.gone:
            return None
        gone = self.spark.read.parquet(*(f"{self._folder(n)}/gone" for n in state.gone))
        return gone.where(F.col("segment").isin(list(state.live)))

    def _rows(self, state: State, name: str) -> DataFrame:
        """The rows of a table of all live segments, with their segment, but those of chunks that are gone."""
        out = None
        for n in state.live:
            part = self.spark.read.parquet(f"{self._folder(n)}/{name}").withColumn("segment", F.lit(n).cast("long"))
            out = part if out is None else out.unionByName(part)
        gone = self._gone(state)
        return out if gone is None else out.join(gone.where("term is null").select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")

    def _chunks(self, state: State | None) -> int:
        if state is None:
            return 0
        gone = self._gone(state)
        return sum(state.live.values()) - (0 if gone is None else gone.where("term is null").count())

    def health(self) -> dict[str, object]:
        state = self._state()
        return {"status": "ok" if state else "empty", "generation": state.generation if state else 0, "chunks": self._chunks(state), "vectors": bool(self.encoder)}

    def _write(self, segment: int, chunks: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None) -> int:
        """A segment of (chunk_id, doc_name, page_num, text); how many chunks it has."""
        folder = self._folder(segment)
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        held = self.spark.read.parquet(f"{folder}/chunks")
        stores.write_index(segments.build(held), f"{folder}/index")
        if vectors:
            vectors(held).write.mode("overwrite").parquet(f"{folder}/vectors")
        return held.count()

    def ingest(self, docs: DataFrame) -> int:
        """Adds (doc_id, text); the number of chunks that they made. Raises if they have no text."""
        with owned():
            new = chunk(docs, self.size, self.overlap).withColumn("doc_name", F.col("doc_id").cast("string")).select(COLUMNS)
            if not new.limit(1).count():
                raise ValueError("the documents have no text")
            state = self._state() or State(0, {}, ())
            number = max([state.generation, *state.live, *state.gone], default=0) + 1
            again = None
            if state.live:
                names = docs.select(F.col("doc_id").cast("string").alias("doc_name")).distinct()
                again = self._rows(state, "chunks").join(names, "doc_name", "left_semi")
            made = self._write(number, new, self._encoded(state, again))
            gone = state.gone
            if again is not None and again.limit(1).count():
                rows = segments.gone_rows(again.select("segment", "chunk_id", tokens(F.col("text")).alias("t")))
                rows.write.mode("overwrite").parquet(f"{self._folder(number)}/gone")
                gone = (*gone, number)
            state = self._merged(State(state.generation + 1, {**state.live, number: made}, gone))
            said = json.dumps({"live": state.live, "gone": state.gone})
            self.spark.createDataFrame([(said,)], "n string").coalesce(1).write.text(f"{self.path}/current-{state.generation}")
        return made

    def _encoded(self, state: State, again: DataFrame | None) -> Callable[[DataFrame], DataFrame] | None:
        """Vectors of new chunks: a chunk whose text stays keeps its vector."""
        if not self.encoder:
            return None
        if again is None:
            return lambda held: dense.encode(held, self.encoder).select("chunk_id", "v")
        known = self._rows(state, "vectors").join(again.select("segment", "chunk_id", F.col("text").alias("old")), ["segment", "chunk_id"])
        return lambda held: dense.encode_missing(held, known.join(held.select("chunk_id", "text"), "chunk_id").where("old = text").select("chunk_id", "v"), self.encoder)

    def _merged(self, state: State) -> State:
        """The state after merging each ``FAN`` segments of one tier: of at most FAN, FAN^2, ... chunks."""
        while True:
            tiers: dict[int, list[int]] = {}
            for n, held in state.live.items():
                tiers.setdefault(int(math.log(max(1, held), FAN) + 1e-9), []).append(n)
            few = next((sorted(x) for x in tiers.values() if len(x) >= FAN), None)
            if few is None:
                return state
            part = State(state.generation, {n: state.live[n] for n in few}, state.gone)
            number = max([state.generation, *state.live, *state.gone]) + 1
            chunks = self._rows(part, "chunks").select(COLUMNS)
            vectors = (lambda _, p=part: self._rows(p, "vectors").select("chunk_id", "v")) if self.encoder else None
            held = self._write(number, chunks, vectors)
            live = {n: c for n, c in state.live.items() if n not in few} | ({number: held} if held else {})
            # what is gone of merged segments needs no mention any more
            gone = self._gone(state)
            left = set() if gone is None else {r["segment"] for r in gone.select("segment").distinct().collect()} & set(live)  # at most a row a segment
            state = State(state.generation, live, state.gone if left else ())

    def query(self, questions: DataFrame, k: int = 2) -> DataFrame:
        """(qid, rank, chunk_id, doc_name, page_num, text, score, mode) of (qid, question).

        Its tables go at the end of a ``lineage.owned`` around the call and the reading of its rows, else when the driver exits.
        """
        state = self._state()
        if state is None:
            raise LookupError("nothing is ingested")
        vectors = None
        if self.encoder:
            vectors, questions = self._rows(state, "vectors").select("chunk_id", "v"), dense.encode(questions, self.encoder, "question", "q")
        index = segments.union({n: stores.read_segment(self.spark, f"{self._folder(n)}/index") for n in state.live}, self._gone(state))
        mode = ranking.mode_of(self.encoder is not None, True)
        best = ranking.Retrieval(index, questions, vectors).top({mode: ranking.MODES[mode]}, k).join(self._rows(state, "chunks").drop("segment"), "chunk_id")
        return best.select("qid", "rank", "chunk_id", "doc_name", "page_num", "text", F.round("score", 4).alias("score"), F.lit(mode).alias("mode"))

    def answer(self, questions: DataFrame, k: int = 2) -> DataFrame:
        """(qid, answer) by rule, from the best chunk."""
        return answers.rule_answers(questions, self.query(questions, k))
