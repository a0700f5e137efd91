"""Tables of external stores as a Spark data source: partitioned reads, writes in batches that are committed as a whole.

A store is reached by any module of Python's database interface. Nothing is
assumed where a setting is missing and nothing else is tried where a store can't
be reached: both raise.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from lodestar.sources.stores import distinct_relations

NAME = "lodestar_store"
RELATION = "head string, rtype string, tail string"
_SQL_TYPES = {T.StringType: "TEXT", T.ShortType: "BIGINT", T.IntegerType: "BIGINT", T.LongType: "BIGINT", T.FloatType: "DOUBLE PRECISION", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.ArrayType: "TEXT"}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Store:
    """How a table is reached, from the options of a read or write."""

    module: str
    connect: str
    table: str
    key: tuple[str, ...] = ()
    order: str | None = None
    batch: int = 500

    @classmethod
    def of(cls, options: dict) -> Store:
        missing = [x for x in ("module", "connect", "table") if not options.get(x)]
        if missing:
            raise ValueError(f"{NAME} needs the options {', '.join(missing)}")
        store = cls(options["module"], options["connect"], options["table"], tuple(x.strip() for x in options.get("key", "").split(",") if x.strip()), options.get("order"), int(options.get("batch", 500)))
        for name in (*store.table.split("."), *store.key, *([store.order] if store.order else [])):
            identifier(name)
        if store.batch < 1:
            raise ValueError("batch must be at least 1")
        return store

    def open(self):
        return closing(importlib.import_module(self.module).connect(**json.loads(self.connect)))

    def marks(self, n: int) -> list[str]:
        """Placeholders of n parameters in the module's own style."""
        style = importlib.import_module(self.module).paramstyle
        if style == "numeric":
            return [f":{k + 1}" for k in range(n)]
        if style not in ("qmark", "format", "pyformat"):
            raise ValueError(f"{self.module} has parameters of style {style}")
        return ["?" if style == "qmark" else "%s"] * n


def identifier(name: str) -> str:
    """``name``, if it can stand in a statement as it is: names are no parameters, so nothing else may."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def _columns(schema: T.StructType) -> list[tuple[str, str]]:
    """(name, type of the store) of each column; a type that the store can't hold raises."""
    for f in schema:
        if type(f.dataType) not in _SQL_TYPES:
            raise ValueError(f"{NAME} holds no column of {f.dataType.simpleString()}: {f.name}")
    return [(identifier(f.name), _SQL_TYPES[type(f.dataType)]) for f in schema]


@dataclass
class Range(InputPartition):
    """Rows of which the partition column lies in [low, high); the first also has its nulls."""

    low: int | None = None
    high: int | None = None
    nulls: bool = True


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.store, self.schema = Store.of(options), schema
        _columns(schema)
        self.by, self.parts = options.get("partition_column"), int(options.get("partitions", 1))
        if self.by:
            identifier(self.by)
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Comparisons of a column with values go into the statement; the rest is left to Spark."""
        kinds = {f.name: type(f.dataType) for f in self.schema}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            plain = name in kinds and kinds[name] is not T.ArrayType
            if plain and isinstance(f, IsNotNull):
                self.wanted.append((f"{name} IS NOT NULL", []))
            elif plain and isinstance(f, In) and all(x is not None for x in f.value):
                self.wanted.append((f"{name} IN ({', '.join(self.store.marks(len(f.value)))})" if f.value else "1 = 0", list(f.value)))
            elif plain and kinds[name] is not T.StringType and type(f) in _SIGNS or plain and isinstance(f, EqualTo):
                self.wanted.append((f"{name} {_SIGNS[type(f)]} {self.store.marks(1)[0]}", [f.value]))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Ranges of equal width between the least and the largest value, in one query of both."""
        if not self.by or self.parts < 2:
            return [Range()]
        with self.store.open() as c:
            cursor = c.cursor()
            cursor.execute(f"SELECT MIN({self.by}), MAX({self.by}) FROM {self.store.table}")
            low, high = cursor.fetchone()
        if low is None:
            return [Range()]
        low, high = int(low), int(high) + 1
        cuts = sorted({low + (high - low) * k // self.parts for k in range(1, self.parts)} - {low, high})
        edges = [None, *cuts, None]
        return [Range(a, b, a is None) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        wanted = list(self.wanted)
        one = self.store.marks(1)[0]
        bounds = [(f"{self.by} {sign} {one}", [x]) for sign, x in ((">=", partition.low), ("<", partition.high)) if x is not None]
        if bounds:
            both = " AND ".join(s for s, _ in bounds)
            wanted.append((f"({both} OR {self.by} IS NULL)" if partition.nulls else both, [x for _, v in bounds for x in v]))
        where = " WHERE " + " AND ".join(s for s, _ in wanted) if wanted else ""
        made = [json.loads if isinstance(f.dataType, T.ArrayType) else bool if isinstance(f.dataType, T.BooleanType) else None for f in self.schema]
        with self.store.open() as c:
            cursor = c.cursor()
            cursor.execute(f"SELECT {', '.join(self.schema.names) or '1'} FROM {self.store.table}{where}", [x for _, v in wanted for x in v])
            while rows := cursor.fetchmany(self.store.batch):
                for row in rows:
                    yield tuple(x if f is None or x is None else f(x) for f, x in zip(made, row, strict=True)) if made else ()


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    rows: int


class Writer(DataSourceWriter):
    """Tasks fill a staging table, each attempt under a name of its own; the commit merges those that Spark took.

    Until then no reader sees anything, an attempt that was lost or repeated
    leaves nothing in the table, and an abort drops the staging table.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.store, self.schema, self.overwrite = Store.of(options), schema, overwrite
        self.columns = _columns(schema)
        strange = set(self.store.key + ((self.store.order,) if self.store.order else ())) - set(schema.names)
        if strange:
            raise ValueError(f"no such column: {', '.join(sorted(strange))}")
        self.stage = f"{self.store.table}_stage_{uuid.uuid4().hex}"
        with self.store.open() as c:
            c.cursor().execute(f"CREATE TABLE {self.stage} ({', '.join(f'{n} {t}' for n, t in self.columns)}, stage_attempt TEXT)")
            c.cursor().execute(f"CREATE TABLE {self.stage}_done (attempt TEXT)")
            c.commit()

    def write(self, iterator: Iterator[Row]) -> Written:
        attempt, rows, lot = uuid.uuid4().hex, 0, []
        lists = [isinstance(f.dataType, T.ArrayType) for f in self.schema]
        keys = [self.schema.names.index(k) for k in self.store.key]
        insert = f"INSERT INTO {self.stage} VALUES ({', '.join(self.store.marks(len(lists) + 1))})"
        with self.store.open() as c:

            def send():
                c.cursor().executemany(insert, lot)
                c.commit()
                lot.clear()

            for row in iterator:
                if any(row[k] is None for k in keys):
                    raise ValueError(f"a null in the key of {self.store.table}")
                lot.append((*(json.dumps(list(x), ensure_ascii=False) if many and x is not None else x for many, x in zip(lists, row, strict=True)), attempt))
                rows += 1
                if len(lot) >= self.store.batch:
                    send()
            if lot:
                send()
        return Written(attempt, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """All or nothing, in one transaction; of rows of one key the latest by ``order`` is merged, then the largest."""
        names = self.schema.names
        cols, key = ", ".join(names), ", ".join(self.store.key)
        primary = f", PRIMARY KEY ({key})" if key else ""
        taken = f"FROM {self.stage} WHERE stage_attempt IN (SELECT attempt FROM {self.stage}_done)"
        if key:
            order = ", ".join(f"{n} DESC" for n in ([self.store.order] if self.store.order else []) + names)
            rest = [n for n in names if n not in self.store.key]
            same = f"DO UPDATE SET {', '.join(f'{n} = excluded.{n}' for n in rest)}" if rest else "DO NOTHING"
            if rest and self.store.order:
                at = f"{self.store.table}.{self.store.order}"
                same += f" WHERE {at} IS NULL OR excluded.{self.store.order} >= {at}"
            merge = f"INSERT INTO {self.store.table} ({cols}) SELECT {cols} FROM (SELECT {cols}, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS stage_n {taken}) AS staged WHERE stage_n = 1 ON CONFLICT ({key}) {same}"
        else:
            merge = f"INSERT INTO {self.store.table} ({cols}) SELECT {cols} {taken}"
        with self.store.open() as c:
            try:
                cursor = c.cursor()
                cursor.execute(f"CREATE TABLE IF NOT EXISTS {self.store.table} ({', '.join(f'{n} {t}' for n, t in self.columns)}{primary})")
                cursor.executemany(f"INSERT INTO {self.stage}_done VALUES ({self.store.marks(1)[0]})", [(m.attempt,) for m in messages if m is not None])
                if self.overwrite:
                    cursor.execute(f"DELETE FROM {self.store.table}")
                cursor.execute(merge)
                c.commit()
            except BaseException:
                c.rollback()
                raise
        self._unstage()

    def abort(self, messages: list[Written | None]) -> None:
        self._unstage()

    def _unstage(self) -> None:
        with self.store.open() as c:
            for name in (self.stage, f"{self.stage}_done"):
                c.cursor().execute(f"DROP TABLE IF EXISTS {name}")
            c.commit()


class StoreSource(DataSource):
    """``spark.read.format("lodestar_store")`` and ``df.write.format("lodestar_store")``.

    Options: ``module`` (of the database interface), ``connect`` (its arguments as
    JSON), ``table``; for writes ``key`` (columns, comma-separated: rows are
    merged by it), ``order`` (a column: an older row never replaces a newer one)
    and ``batch`` (rows a statement, 500); for reads ``partition_column`` (of
    integers) and ``partitions``. Reads need a schema, and only its columns are
    fetched. Lists are held as JSON text. Modes are append and overwrite.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def from_env(prefix: str = "LODESTAR_STORE") -> dict[str, str]:
    """``module`` and ``connect`` from PREFIX_MODULE and PREFIX_CONNECT; a missing one raises."""
    names = {x: f"{prefix}_{x.upper()}" for x in ("module", "connect")}
    missing = [n for n in names.values() if not os.environ.get(n)]
    if missing:
        raise RuntimeError(f"not set: {', '.join(missing)}")
    return {x: os.environ[n] for x, n in names.items()}


def save(rows: DataFrame, options: dict, table: str, key: str = "", mode: str = "append", **more) -> None:
    register(rows.sparkSession)
    rows.write.format(NAME).options(**options, table=table, key=key, **more).mode(mode).save()


def load(spark: SparkSession, options: dict, table: str, schema: str, **more) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).schema(schema).options(**options, table=table, **more).load()


def write_graph(relations: DataFrame, options: dict, mode: str = "overwrite", batch: int = 500) -> None:
    """Relations and their entities, each once: loading the same again changes nothing."""
    each = distinct_relations(relations)
    save(each.select(F.explode(F.array("head", "tail")).alias("eid")).distinct(), options, "entity", "eid", mode, batch=batch)
    save(each, options, "relation", "head,rtype,tail", mode, batch=batch)


def read_graph(spark: SparkSession, options: dict) -> DataFrame:
    """(head, rtype, tail), for the operators of graphs; filters on a column reach the store."""
    return load(spark, options, "relation", RELATION)


def upsert_vectors(vectors: DataFrame, options: dict, table: str = "collection", batch: int = 500) -> None:
    """Adds (chunk_id, v, version) or replaces older rows of a chunk."""
    save(vectors.select("chunk_id", "v", "version"), options, table, "chunk_id", order="version", batch=batch)


def read_vectors(spark: SparkSession, options: dict, table: str = "collection", **more) -> DataFrame:
    """(chunk_id, v, version), for nearest-neighbour search by ``stores.query`` or a proximity graph."""
    return load(spark, options, table, "chunk_id string, v array<double>, version long", **more)
