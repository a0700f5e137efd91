"""WARC archives with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.runtime import cut, drop, remove, table_path, tune

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Two line ends close a record; Spark's text writer puts them after each row.
CLOSE = CRLF + CRLF
#: Bytes of the payloads of one archive file, at most (a larger payload has a file of its own), and its records.
FILE_BYTES, FILE_RECORDS = 128 << 20, 2_000
#: The head that a response carries before its payload.
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Base32 of the SHA-1 of binary data: each five hex digits are four symbols."""
    digits = F.sha1(payload)
    symbols = []
    for k in range(8):
        bits = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            symbols.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*symbols)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _head(lines: list[tuple[str, Column]]) -> Column:
    """Header lines; one whose value is null is left out."""
    parts = [F.lit("WARC/1.1" + CRLF)]
    for name, value in lines:
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def records(pages: DataFrame, when: str) -> Column:
    """The text of a record of (page_id, url, payload, digest, refers_to, refers_url); a revisit has the HTTP head alone."""
    common = [("WARC-Record-ID", record_id(F.col("page_id"))), ("WARC-Target-URI", one_line(F.col("url"))), ("WARC-Date", F.lit(when)),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))]
    length = F.octet_length("payload") + len(HTTP_HEAD)
    response = F.concat(_head([("WARC-Type", F.lit("response")), *common, ("Content-Length", length.cast("string"))]), F.lit(HTTP_HEAD), F.col("payload"))
    revisit = F.concat(_head([
        ("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id(F.col("refers_to"))),
        ("WARC-Refers-To-Target-URI", one_line(F.col("refers_url"))), ("WARC-Refers-To-Date", F.lit(when)), ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Length", F.lit(str(len(HTTP_HEAD)))),
    ]), F.lit(HTTP_HEAD))
    return F.when(F.col("refers_to").isNull(), response).otherwise(revisit)


def size_class(payload: Column) -> Column:
    """0 for payloads of which ``FILE_RECORDS`` fill ``FILE_BYTES`` at most, then one for each factor of eight."""
    least = FILE_BYTES // FILE_RECORDS
    size = F.greatest(F.coalesce(F.octet_length(payload), F.lit(0)), F.lit(least)).cast("double")
    return F.ceil(F.log(size / least) / F.log(F.lit(8.0)) - 1e-9).cast("int")


def size_classes(rows: DataFrame) -> list[int]:
    """The classes of the payloads of ``rows``: one for each factor of eight."""
    return sorted(r[0] for r in rows.select(size_class(F.col("payload")).alias("c")).distinct().collect()) or [0]


def write_archives(rows: DataFrame, path: str, when: str, size: int) -> None:
    """Writes records of one class of payload sizes as gzip archives through Spark's committer.

    The records of a file are bounded so that payloads of the class stay within
    ``FILE_BYTES``: a reader, which gets a whole file in one row, never meets a
    large one unless a single payload is large. The text writer puts ``CLOSE``
    after every row, which is what ends a WARC record, so files are valid
    archives on any file system that Spark writes.
    """
    (rows.select(records(rows, when).alias("record")).write.option("lineSep", CLOSE).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", max(1, FILE_RECORDS // 8**size)).text(f"{path}/size-{size}"))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            # a url keeps its white space but for the one space behind the colon
            head[name] = value.removeprefix(" ") if name == "warc-target-uri" else value.strip()
        block = stream.read(int(head.get("content-length", "0")))
        yield head, block


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "url", "type", "digest", "bytes", "refers", "payload"]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    response = head["warc-type"] == "response"
                    if head.get("content-type", "").startswith("application/http"):
                        block = block[block.index(b"\r\n\r\n") + 4 :]
                    if response and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"damaged record {head['warc-record-id']}")
                    size = len(block) if response else int(head["x-payload-length"])
                    rows.append((head["warc-record-id"], head.get("warc-target-uri"), head["warc-type"], digest, size, head.get("warc-refers-to"), block.decode("utf-8", "replace") if with_payload else None))
                    held += len(block) if with_payload else 0
                    if len(rows) >= 1000 or held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return run


_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_SCHEMA = "record string, url string, type string, digest string, bytes long, refers string, payload string"


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """(record, url, type, digest, bytes, refers, payload) of the records under ``path``.

    Digests of responses are checked against their blocks; a damaged record fails the read.
    A file is one row, so files are written within ``FILE_BYTES`` of payloads.
    """
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _SCHEMA)


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, bytes, refers_to, refers_url) from (page_id, url, digest, bytes).

    Only headers are shuffled. The first of a digest and length is the smallest
    page id, found with map-side combining; every header then joins it by digest
    and length, a join whose large groups Spark can split.
    """
    first = headers.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(F.struct("page_id", "url")).alias("first"))
    joined = headers.join(first, ["digest", "bytes"], "left")
    again = F.col("first.page_id").isNotNull() & (F.col("first.page_id") < F.col("page_id"))
    return joined.select(
        "page_id", "digest", "bytes", F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"),
    )


def deduplicate(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                when: str = "2024-01-01T00:00:00Z", path: str | None = None) -> tuple[DataFrame, str]:
    """Archives pages, deduplicates the archives by revisit records; (records as read back, path of the archives).

    Archives written to ``path`` stay there; without one they lie in the shared
    folder until the driver exits. ``when`` is the date of all records.

    Pages are first written as one response record each and read back, so the
    resolution works on archives alone: headers are shuffled by payload digest
    and length, and of equal payloads of at least ``least`` bytes the smallest
    page id stays a response while the others refer to it. The deduplicated
    archives get fresh headers; a revisit carries no payload.

    A null body is an empty payload. A null url has no header and is null when read; line ends in urls become spaces. Ids must be
    integers and are taken as unique: of rows that repeat one, each is written and
    all resolve alike; a null id is a response of its own. Extra columns are ignored. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    none = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("refers_url", F.lit(None).cast("string"))
    raw, final = table_path(spark, "warc-raw"), path or table_path(spark, "warc")
    classes = size_classes(rows)
    for c in classes:
        write_archives(none.where(size_class(F.col("payload")) == c), raw, when, c)
    number = F.regexp_extract("record", r"<urn:page:(-?\d*)>", 1)
    page_id = F.when(number != "", number.cast("long"))
    headers = cut(read_archives(spark, raw).select(page_id.alias("page_id"), "url", "digest", "bytes"), "warc-headers")
    links = resolve(headers, least).where("refers_to is not null").groupBy("page_id", "digest", "bytes").agg(F.first("refers_to").alias("refers_to"), F.first("refers_url").alias("refers_url"))
    for c in classes:  # each class reads its own folder
        again = read_archives(spark, f"{raw}/size-{c}", with_payload=True).select(page_id.alias("page_id"), "url", "digest", "bytes", "payload")
        # a response keeps its payload beside the join; only a revisit's is dropped
        write_archives(again.join(links, ["page_id", "digest", "bytes"], "left"), final, when, c)
    target = F.regexp_extract("refers", r"<urn:page:(-?\d*)>", 1)
    out = read_archives(spark, final).select(
        page_id.alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.coalesce(target, F.lit("")) != "", target.cast("long")).alias("refers_to"), F.col("url").alias("target_uri"),
    )
    drop(headers)
    remove(spark, raw)
    return out, final
