"""Splitting documents into chunks and tying relations to the chunks that state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import without_space
from lodestar.plans.lineage import cut

SIZE, OVERLAP = 1000, 150
RELATION = "array<struct<head:string,rtype:string,tail:string>>"


def split_lines(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of whole lines: a full buffer is closed and its last lines, up to ``overlap``, begin the next.

    Blank lines go; lengths do not count line ends; a line longer than ``size`` is never cut.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))
    return _bound(lines, lambda ls: _bound(F.transform(ls, lambda x: F.length(x)), lambda lengths: _chunks(ls, lengths, size, overlap)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named: inside a lambda an expression would be computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(lines: Column, lengths: Column, size: int, overlap: int) -> Column:
    spans = F.array().cast("array<struct<s:int,e:int>>")

    def back(start: Column, end: Column) -> Column:
        """How many of the last lines begin the next chunk, and their length."""
        step = lambda x, j: F.when(x.n >= overlap, x).otherwise(F.struct((x.k + 1).alias("k"), (x.n + F.get(lengths, j)).alias("n")))
        return F.aggregate(F.sequence(end - 1, start), F.struct(F.lit(0).alias("k"), F.lit(0).alias("n")), step)

    def add(acc: Column, length: Column) -> Column:
        # only a chunk that closes looks back and adds to an array; a line moves three numbers
        closed = lambda kept: F.struct(
            F.array_append(acc.ch, F.struct(acc.s.alias("s"), acc.i.alias("e"))).alias("ch"), (acc.i - kept.k).alias("s"), (kept.n + length).alias("n"), (acc.i + 1).alias("i"),
        )
        goes_on = F.struct(acc.ch.alias("ch"), acc.s.alias("s"), (acc.n + length).alias("n"), (acc.i + 1).alias("i"))
        return F.when((acc.n + length > size) & (acc.i > acc.s), _bound(back(acc.s, acc.i), closed)).otherwise(goes_on)

    start = F.struct(spans.alias("ch"), F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("i"))
    last = lambda x: F.when(x.i > x.s, F.array_append(x.ch, F.struct(x.s.alias("s"), x.i.alias("e")))).otherwise(x.ch)
    # lines by their places: a slice would copy all of them
    return F.transform(F.aggregate(lengths, start, add, last), lambda c: F.array_join(F.transform(F.sequence(c.s, c.e - 1), lambda j: F.get(lines, j)), "\n"))


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page_num, chunk_id, text)."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.col(text_col), size, overlap)).alias("page_num", "text"))
    return parts.select("doc_id", "page_num", F.format_string("%s#c%03d", F.col("doc_id").cast("string"), F.col("page_num")).alias("chunk_id"), "text")


def entity_id(kind: Column | str, name: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), name)


def tail_kind(rtype: Column) -> Column:
    return F.when(rtype == "ISSUED_BY", "agency").when(rtype == "REQUIRES", "tech").when(rtype == "HAS_BUDGET", "budget").when(rtype == "HAS_PERIOD", "period")


def locate(triples: DataFrame, chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Triples (doc_id, seq, head, rtype, tail, evidence) with ``page_num`` of the chunk that states each, or null.

    The evidence, without white space and of 8 characters at least, is looked
    for in full and then by its first half (8 characters at least); a required
    technology is then looked for by its surface forms in their order, and an
    issuer falls back to the first chunk. The join is by document, so a triple
    meets its own chunks only.
    """
    need = triples.withColumn("need", without_space(F.coalesce("evidence", F.lit(""))))
    need = need.withColumn("probe", F.left("need", F.greatest(F.lit(8), F.floor(F.length("need") / 2)).cast("int")))
    places = chunks.select("doc_id", "page_num", without_space(F.col("text")).alias("hay"))
    met = need.join(places, "doc_id", "left")
    stage = F.when(F.length("need") >= 8, F.when(F.col("hay").contains(F.col("need")), 0).when(F.col("hay").contains(F.col("probe")), 1))
    keys = ["doc_id", "seq", "head", "rtype", "tail", "evidence"]
    found = met.groupBy(*keys).agg(
        F.min(F.when(stage.isNotNull(), F.struct(stage.alias("stage"), F.col("page_num").alias("page_num"))))["page_num"].alias("by_text"), F.min("page_num").alias("first_page"),
    )
    if aliases is not None:
        forms = aliases.select(F.col("canon").alias("tail"), "form_rank", without_space(F.col("form")).alias("probe")).where(F.length("probe") >= 2)
        surface = (
            triples.where("rtype = 'REQUIRES'").select("doc_id", "seq", "tail").join(forms, "tail").join(places, "doc_id").where(F.col("hay").contains(F.col("probe")))
            .groupBy("doc_id", "seq").agg(F.min(F.struct("form_rank", "page_num"))["page_num"].alias("by_surface"))
        )
        found = found.join(surface, ["doc_id", "seq"], "left")
    else:
        found = found.withColumn("by_surface", F.lit(None).cast("int"))
    page = F.coalesce("by_text", F.when(F.col("rtype") == "REQUIRES", F.col("by_surface")), F.when(F.col("rtype") == "ISSUED_BY", F.col("first_page")))
    return found.select(*keys, page.alias("page_num"))


def build_corpus(docs: DataFrame, triples: DataFrame, aliases: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> dict[str, DataFrame]:
    """Tables chunks, entities, relations, home and unlinked.

    ``relations`` keeps repeats in order; ``home`` has the first chunk of each
    relation; a chunk's ``states`` keep repeats and its ``entities`` do not. A document
    without chunks leaves its relations unlinked.
    """
    # all tables below read these two, which are made once
    chunks = cut(chunk(docs, size, overlap))
    placed = cut(locate(triples, chunks, aliases))
    kind = tail_kind(F.col("rtype"))
    rel = placed.select(
        "doc_id", "seq", entity_id("project", F.col("head")).alias("head"), "rtype", entity_id(kind, F.col("tail")).alias("tail"),
        F.col("head").alias("head_name"), F.col("tail").alias("tail_name"), kind.alias("kind"), "page_num",
    )
    both = rel.select(F.explode(F.array(
        F.struct(F.col("head").alias("eid"), F.col("head_name").alias("name"), F.lit("project").alias("etype")),
        F.struct(F.col("tail").alias("eid"), F.col("tail_name").alias("name"), F.col("kind").alias("etype")),
    )).alias("e"))
    entities = both.select("e.*").distinct()
    linked = rel.where("page_num is not null").withColumn("chunk_id", F.format_string("%s#c%03d", F.col("doc_id").cast("string"), F.col("page_num")))
    home = linked.groupBy("head", "rtype", "tail").agg(F.min_by("chunk_id", F.struct("doc_id", "seq")).alias("chunk_id"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "head", "rtype", "tail")))
    stated = linked.groupBy("chunk_id").agg(ordered.alias("s")).select(
        "chunk_id", F.transform("s", lambda x: F.struct(x.head.alias("head"), x.rtype.alias("rtype"), x.tail.alias("tail"))).alias("states"),
        F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x.head, x.tail)))).alias("entities"),
    )
    out = chunks.join(stated, "chunk_id", "left").select(
        "chunk_id", F.col("doc_id").cast("string").alias("doc_name"), "page_num", "text", F.coalesce("states", F.array().cast(RELATION)).alias("states"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
    )
    return {
        "chunks": out, "entities": entities, "relations": rel.select("doc_id", "seq", "head", "rtype", "tail"), "home": home,
        "unlinked": rel.where("page_num is null").select("doc_id", "seq", F.col("head_name").alias("head"), "rtype", F.col("tail_name").alias("tail")),
    }


def corpus_summary(corpus: dict[str, DataFrame]) -> DataFrame:
    """One row: sizes, link rate (homes by relations with repeats) and distractors."""
    c = corpus["chunks"].agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_name").alias("docs"), F.count_if(F.size("states") == 0).alias("distractors"))
    r = corpus["relations"].agg(F.count(F.lit(1)).alias("relations"))
    h = corpus["home"].agg(F.count(F.lit(1)).alias("homes"))
    e = corpus["entities"].agg(F.count(F.lit(1)).alias("entities"))
    one = c.crossJoin(r).crossJoin(h).crossJoin(e)  # four tables of one row
    return one.withColumn("link_rate", F.when(F.col("relations") > 0, F.col("homes") / F.col("relations")).otherwise(F.lit(0.0)))


def relation_home(chunks: DataFrame) -> DataFrame:
    """(head, rtype, tail, chunk_id); a relation that two chunks state raises when read."""
    rows = chunks.select("chunk_id", F.explode("states").alias("s")).select("chunk_id", "s.*")
    once = rows.groupBy("head", "rtype", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("chunk_id"))
    return once.select("head", "rtype", "tail", F.when(F.col("n") == 1, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("stated twice: "), F.col("head")))).alias("chunk_id"))


#: How each relation type reads.
SENTENCES = {
    "CONTAINS": "{head}은(는) {tail}을(를) 포함한다.",
    "CONNECTS_TO": "{head}은(는) {tail}과(와) 연결된다.",
    "HAS_SPEC": "{head}의 사양은 {tail}이다.",
    "SUPPLIED_BY": "{head}은(는) {tail}에서 공급한다.",
}


def render_corpus(plan: DataFrame, relations: DataFrame, entities: DataFrame, distractors: DataFrame | None = None) -> DataFrame:
    """Chunks from a plan (doc_name, page_num, title, seq, rel_id), relations (rel_id, head, rtype, tail) and entities.

    A chunk's text is ``[title]`` and a sentence for each of its relations, in
    the order of ``seq``. ``distractors`` (doc_name, page_num, title, text) state nothing.
    """
    name = entities.select("eid", "name")
    sentence = F.lit(None).cast("string")
    for rtype, template in SENTENCES.items():
        text = F.replace(F.replace(F.lit(template), F.lit("{head}"), F.col("head_name")), F.lit("{tail}"), F.col("tail_name"))
        sentence = F.when(F.col("rtype") == rtype, text).otherwise(sentence)
    rows = (
        plan.join(relations, "rel_id").join(name.withColumnsRenamed({"eid": "head", "name": "head_name"}), "head")
        .join(name.withColumnsRenamed({"eid": "tail", "name": "tail_name"}), "tail").withColumn("sentence", sentence)
    )
    s = rows.groupBy("doc_name", "page_num", "title").agg(F.sort_array(F.collect_list(F.struct("seq", "head", "rtype", "tail", "sentence"))).alias("s"))
    out = s.select(
        F.format_string("%s#p%d", "doc_name", "page_num").alias("chunk_id"), "doc_name", "page_num",
        F.concat(F.lit("["), F.col("title"), F.lit("] "), F.array_join(F.transform("s", lambda x: x.sentence), " ")).alias("text"),
        F.transform("s", lambda x: F.struct(x.head.alias("head"), x.rtype.alias("rtype"), x.tail.alias("tail"))).alias("states"),
        F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x.head, x.tail)))).alias("entities"),
    )
    if distractors is None:
        return out
    extra = distractors.select(
        F.format_string("%s#p%d", "doc_name", "page_num").alias("chunk_id"), "doc_name", "page_num", F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("text")).alias("text"),
        F.array().cast(RELATION).alias("states"), F.array().cast("array<string>").alias("entities"),
    )
    return out.unionByName(extra)


def first_of_document(chunks: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    return chunks.withColumn("nth", rank).where("nth = 1").drop("nth")
