"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's documents. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, langid, mixing, ngram_join, packing
from lodestar.llm.runtime import cut, documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, or no letter); learns from the languages that documents carry.

    Null ids, repeated rows and very long texts are rows like others; if no document names a language, all stay.
    """
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts; a null id loses to any other, of repeated rows one stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of documents linked at 0.8 on shingles of five words.

    Empty texts and rows without an id link with nothing and stay.
    """
    return ngram_join.deduplicate(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents until sources have their target shares; a null source is a source, wordless texts go."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the mixed documents in windows of 4,096, one row per piece; a null text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("exact deduplication", exact_copies),
    ("near deduplication", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages 1 and 5 are not SQL; tests/llm compares the whole with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages, each written as a table and read again.

    Columns of documents may be null and have any names; repeated rows, ties and
    very long texts have the results that the stages state; an empty table gives an
    empty result.
    """
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
