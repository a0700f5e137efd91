"""Pages of documents: headings, tables, content types, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.lineage import cut

HEADING_FACTOR = 1.2


def mark_headings(lines: DataFrame) -> DataFrame:
    """Lines (doc_name, page_num, line_num, text, size) whose size is above 1.2 times the document's mean get a mark."""
    mean = F.avg("size").over(Window.partitionBy("doc_name"))
    return lines.withColumn("is_heading", F.col("size") > mean * HEADING_FACTOR).withColumn("text", F.when(F.col("is_heading"), F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text")))


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a padded table: the first row is the head; null cells are empty."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    columns = F.sequence(F.lit(0), F.size(F.get(cells, F.lit(0))) - 1)
    width = lambda k: F.array_max(F.transform(cells, lambda r: F.length(F.get(r, k))))
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    body = F.transform(cells, lambda r: line(F.transform(columns, lambda k: F.rpad(F.get(r, k), F.greatest(width(k), F.length(F.get(r, k))), F.lit(" ")))))
    dashes = line(F.transform(columns, lambda k: F.repeat(F.lit("-"), width(k))))
    full = F.concat(F.slice(body, 1, 1), F.array(dashes), F.slice(body, F.lit(2), F.size(body)))
    return F.when((F.size(rows) > 0) & (F.size(F.get(rows, F.lit(0))) > 0), F.array_join(full, "\n")).otherwise(F.lit(""))


def page_chunks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """One chunk a page from lines and tables (doc_name, page_num, table_num, rows)."""
    marked = mark_headings(lines).groupBy("doc_name", "page_num").agg(F.sort_array(F.collect_list(F.struct("line_num", "text")))["text"].alias("lines"))
    md = tables.select("doc_name", "page_num", F.struct("table_num", table_markdown(F.col("rows")).alias("md")).alias("t")).groupBy("doc_name", "page_num").agg(F.sort_array(F.collect_list("t"))["md"].alias("tables"))
    page = marked.join(md, ["doc_name", "page_num"], "full_outer")
    body = F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")
    text = F.when(F.size("tables") > 0, F.concat(body, F.lit("\n\n"), F.array_join("tables", "\n\n"))).otherwise(body)
    length = F.coalesce(F.aggregate("tables", F.lit(0), lambda s, x: s + F.length(x)), F.lit(0))
    return page.withColumn("raw", text).select(
        "doc_name", "page_num", F.format_string("%s_p%03d", "doc_name", "page_num").alias("chunk_id"), F.trim("raw").alias("text"), F.lit(None).cast("string").alias("image_path"),
        content_type(length, F.length("raw")).alias("content_type"), (F.coalesce(F.size("tables"), F.lit(0)) > 0).alias("has_table"), F.length("raw").alias("char_count"),
    )


def content_type(table_length: Column, length: Column) -> Column:
    return F.when(table_length > length * 0.5, "table_heavy").when(length > 200, "text_heavy").otherwise(F.lit("mixed"))


def html_text(html: Column) -> Column:
    """Visible text, block ends as line ends."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    lines = F.regexp_replace(bare, r"(?i)</(p|h[1-6]|li|div|tr|title)>|<br ?/?>", "\n")
    return F.regexp_replace(lines, "<[^>]*>", "")


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, heading) of h1..h3."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<h[1-3][^>]*>([^<]*)</h[1-3]>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "heading"))


_LINE, _TABLE = "struct<page_num:int,line_num:int,text:string,size:double>", "struct<page_num:int,table_num:int,rows:array<array<string>>>"


def parse_files(spark, path: str, parser, pattern: str = "*.pdf") -> DataFrame:
    """(doc_name, lines, tables, status) of files, by an injected parser.

    ``parser`` takes the bytes of a file and gives lines (page_num, line_num,
    text, size) and tables (page_num, table_num, rows). A file that fails has
    empty lists and ``failed: <error>`` as its status, and does not stop the
    others; the rest is ``ok``. The name of a document is the stem of its file,
    so reading a file again gives the same ids.
    """
    from collections.abc import Iterator

    import pandas as pd

    def one(content):
        try:
            lines, tables = parser(bytes(content))
            return (
                [dict(zip(("page_num", "line_num", "text", "size"), x, strict=True)) for x in lines],
                [dict(zip(("page_num", "table_num", "rows"), x, strict=True)) for x in tables], "ok",
            )
        except Exception as e:  # noqa: BLE001  the status column reports it
            return [], [], f"failed: {type(e).__name__}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [one(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "lines": [x for x, _, _ in found], "tables": [x for _, x, _ in found], "status": [x for _, _, x in found]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    parsed = files.mapInPandas(run, f"path string, lines array<{_LINE}>, tables array<{_TABLE}>, status string")
    return parsed.select(F.url_decode(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("doc_name"), "lines", "tables", "status")


def read_files(spark, path: str, parser, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """Lines and tables of the files that ``parse_files`` can read, for ``page_chunks``."""
    parsed = cut(parse_files(spark, path, parser, pattern))  # every file is parsed once
    return parsed.select("doc_name", F.explode("lines").alias("l")).select("doc_name", "l.*"), parsed.select("doc_name", F.explode("tables").alias("t")).select("doc_name", "t.*")
