"""Evaluation questions derived from the graph, with their gold chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import fill, format_won, korean_units, number_set
from lodestar.operators.extract import naming
from lodestar.operators.graph import directed_edges, unique_steps
from lodestar.plans.lineage import cut, numbered

MAX_GOLD = 3
# How questions read, by relation type and direction. (kind, type, forward, template)
TEMPLATES = (
    ("one", "CONTAINS", True, "{a}은(는) 어떤 부품으로 구성되는가?"),
    ("one", "CONNECTS_TO", True, "{a}은(는) 어떤 부품과 연결되는가?"),
    ("one", "HAS_SPEC", True, "{a}의 사양은 무엇인가?"),
    ("one", "SUPPLIED_BY", True, "{a}은(는) 어디에서 공급하는가?"),
    ("one", "CONTAINS", False, "{a}을(를) 포함하는 상위 항목은 무엇인가?"),
    ("one", "CONNECTS_TO", False, "{a}에 연결되는 부품은 무엇인가?"),
    ("one", "SUPPLIED_BY", False, "{a}이(가) 공급하는 부품은 무엇인가?"),
    ("phrase", "CONTAINS", True, "{a}이(가) 포함하는 부품"),
    ("phrase", "CONNECTS_TO", True, "{a}과(와) 연결된 부품"),
    ("phrase", "SUPPLIED_BY", True, "{a}을(를) 공급하는 회사"),
    ("phrase", "CONTAINS", False, "{a}을(를) 포함하는 상위 항목"),
    ("phrase", "CONNECTS_TO", False, "{a}에 연결되는 부품"),
    ("phrase", "SUPPLIED_BY", False, "{a}이(가) 공급하는 부품"),
    ("tail", "CONTAINS", True, "의 구성 부품은 무엇인가?"),
    ("tail", "CONNECTS_TO", True, "과(와) 연결된 부품은 무엇인가?"),
    ("tail", "HAS_SPEC", True, "의 사양은 무엇인가?"),
    ("tail", "SUPPLIED_BY", True, "은(는) 어디에서 공급하는가?"),
    ("tail", "CONTAINS", False, "을(를) 포함하는 상위 항목은 무엇인가?"),
    ("tail", "CONNECTS_TO", False, "에 연결되는 부품은 무엇인가?"),
    ("tail", "SUPPLIED_BY", False, "이(가) 공급하는 부품은 무엇인가?"),
)
REAL_ONE = (("HAS_BUDGET", "{a}의 사업 예산은 얼마인가?"), ("HAS_PERIOD", "{a}의 사업 기간은 얼마인가?"))
REAL_TWO = (
    ("HAS_BUDGET", "{a}이(가) 발주한 사업의 예산은 얼마인가?"), ("HAS_PERIOD", "{a}이(가) 발주한 사업의 기간은 얼마인가?"), ("REQUIRES", "{a}이(가) 발주한 사업은 어떤 기술을 요구하는가?"),
)


def template_table(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(rows), "kind string, rtype string, forward boolean, template string")


def _kind(templates: DataFrame, kind: str) -> DataFrame:
    return F.broadcast(templates.where(F.col("kind") == kind).drop("kind"))  # one row a relation type and direction


def one_hop(edges: DataFrame, home: DataFrame, entities: DataFrame, templates: DataFrame, max_gold: int = MAX_GOLD) -> DataFrame:
    """(question, hops, gold, seeds): all homes of the edges that leave an entity by one type and direction."""
    met = edges.join(home, ["head", "rtype", "tail"]).groupBy("src", "rtype", "forward").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold"))
    asked = met.where(F.size("gold") <= max_gold).join(_kind(templates, "one"), ["rtype", "forward"]).join(entities.select(F.col("eid").alias("src"), "name"), "src")
    return asked.select(fill(F.col("template"), F.col("name")).alias("question"), F.lit(1).alias("hops"), "gold", F.array("src").alias("seeds"))


def two_hop(edges: DataFrame, home: DataFrame, entities: DataFrame, entities_of: DataFrame, templates: DataFrame, max_gold: int = MAX_GOLD) -> DataFrame:
    """(question, hops, gold, seeds) by way of an unnamed entity.

    The first step must be the only one of its type and direction; the second
    may lead to several entities, but not back. Gold is 2..``max_gold`` chunks, and
    no entity of all of them is named in the question. How many chunks a second
    step has is counted before the steps meet, so a hub of many ends, which has too
    many for a question, meets none of its entities.
    """
    homed = edges.join(home, ["head", "rtype", "tail"])
    first = homed.join(unique_steps(edges), ["src", "rtype", "forward"]).join(_kind(templates, "phrase"), ["rtype", "forward"]).select(
        "src", F.col("rtype").alias("r1"), F.col("forward").alias("f1"), F.col("dst").alias("via"), F.col("chunk_id").alias("g1"), F.col("template").alias("phrase"),
    )
    second = homed.select(F.col("src").alias("via"), F.col("rtype").alias("r2"), F.col("forward").alias("f2"), F.col("dst").alias("far"), F.col("chunk_id").alias("g2"))
    step = ["via", "r2", "f2"]
    # a chunk that has one far end alone does not count for a question from there
    ends = cut(second.where(F.col("far") != F.col("via")).groupBy(*step, "g2").agg(F.min("far").alias("least"), F.max("far").alias("most")))
    lone = ends.where("least = most").groupBy(*step, F.col("least").alias("src")).agg(F.count(F.lit(1)).alias("own"))
    sizes = ends.groupBy(*step).agg(F.count(F.lit(1)).alias("size"))
    asked = first.join(sizes, "via").join(lone, [*step, "src"], "left").where((F.col("size") - F.coalesce("own", F.lit(0))).between(1, max_gold)).drop("size", "own")
    met = asked.join(ends, step).where((F.col("least") != F.col("most")) | (F.col("least") != F.col("src")))
    rows = met.groupBy("src", "r1", "f1", "r2", "f2", "phrase").agg(F.array_sort(F.array_union(F.collect_set("g1"), F.collect_set("g2"))).alias("gold"))
    rows = rows.where(F.size("gold").between(2, max_gold))
    tail = _kind(templates, "tail").select(F.col("rtype").alias("r2"), F.col("forward").alias("f2"), F.col("template").alias("tail"))
    asked = rows.join(tail, ["r2", "f2"]).join(entities.select(F.col("eid").alias("src"), "name"), "src")
    asked = asked.withColumn("question", F.concat(fill(F.col("phrase"), F.col("name")), F.col("tail"))).withColumn("key", F.concat_ws("|", "src", "r1", F.col("f1").cast("string"), "r2", F.col("f2").cast("string")))
    anchored = shared_anchors(asked.select(F.col("key").alias("qid"), "question", "gold"), entities, entities_of).select(F.col("qid").alias("key")).distinct()
    return asked.join(anchored, "key", "left_anti").select("question", F.lit(2).alias("hops"), "gold", F.array("src").alias("seeds"))


def shared_anchors(queries: DataFrame, entities: DataFrame, entities_of: DataFrame) -> DataFrame:
    """(qid, eid) of entities in all gold chunks of a question that names them."""
    rows = queries.select("qid", "question", F.size("gold").alias("n"), F.explode("gold").alias("chunk_id")).join(entities_of, "chunk_id")
    common = rows.groupBy("qid", "question", "eid").agg(F.countDistinct("chunk_id").alias("c"), F.first("n").alias("n")).where("c = n")
    return common.join(entities.select("eid", "name"), "eid").where(F.col("question").contains(F.col("name"))).select("qid", "eid")


def leaks(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, eid) of entities that a question of two hops names though they are no seed, nor part of a seed's name."""
    multi = queries.where("hops >= 2")
    named = naming(multi.select("qid", "question"), entities.select("eid", "name").where(F.length("name") > 0)).select("qid", "eid", "name")
    seeds = multi.select("qid", F.explode("seeds").alias("seed")).join(entities.select(F.col("eid").alias("seed"), F.col("name").alias("seed_name")), "seed")
    at = seeds.select(F.col("qid").alias("q2"), "seed", "seed_name")
    return named.join(at, (F.col("qid") == F.col("q2")) & ((F.col("eid") == F.col("seed")) | F.col("seed_name").contains(F.col("name"))), "left_anti").select("qid", "eid")


def finalize(queries: DataFrame, prefix: str = "g", digits: int = 3) -> DataFrame:
    """Adds qid by the order of (hops, question, gold): a number of ``digits`` digits, or of more where it needs them."""
    rows = numbered(queries, ["hops", "question", "gold"], "__n", 1)
    number = F.col("__n").cast("string")
    return rows.select(F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(digits)), F.lit("0"))).alias("qid"), *queries.columns)


def generate(relations: DataFrame, home: DataFrame, entities: DataFrame, entities_of: DataFrame, max_gold: int = MAX_GOLD) -> DataFrame:
    edges, templates = directed_edges(relations), template_table(relations.sparkSession)
    return finalize(one_hop(edges, home, entities, templates, max_gold).unionByName(two_hop(edges, home, entities, entities_of, templates, max_gold)))


def from_spec(spec: DataFrame, home: DataFrame, entities: DataFrame) -> DataFrame:
    """Questions by hand: (qid, question, hops, rels array of (head, rtype, tail), seeds) with gold from the homes.

    A relation without a home, or an unknown seed, raises when read.
    """
    rows = spec.select("qid", "question", "hops", "seeds", F.posexplode("rels").alias("i", "r")).select("qid", "question", "hops", "seeds", "i", "r.*")
    met = rows.join(home, ["head", "rtype", "tail"], "left").withColumn("chunk_id", F.coalesce("chunk_id", F.raise_error(F.concat(F.col("qid"), F.lit(": unknown relation")))))
    gold = met.groupBy("qid", "question", "hops", "seeds").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("i", "chunk_id")))["chunk_id"]).alias("gold"))
    known = spec.select("qid", F.explode("seeds").alias("eid")).join(entities.select("eid", F.lit(1).alias("known")), "eid", "left")
    checked = known.groupBy("qid").agg(F.min(F.coalesce("known", F.lit(0))).alias("known"))
    out = gold.join(checked, "qid")
    return out.select("qid", F.when(F.col("known") == 1, F.col("question")).otherwise(F.raise_error(F.concat(F.col("qid"), F.lit(": unknown seed")))).alias("question"), "hops", "gold", "seeds")


def split_holdout(queries: DataFrame) -> DataFrame:
    """Adds ``split``: within each number of hops, by qid, even places are dev and odd ones test."""
    rows = cut(numbered(queries, ["hops", "qid"], "__n"))
    first = rows.groupBy("hops").agg(F.min("__n").alias("__first"))
    n = F.col("__n") - F.col("__first")
    met = rows.alias("a").join(first.alias("b"), F.col("a.hops").eqNullSafe(F.col("b.hops")))
    return met.select(*[f"a.{c}" for c in queries.columns], F.when(n % 2 == 0, "dev").otherwise(F.lit("test")).alias("split"))


def real_questions(home: DataFrame, entities: DataFrame, entities_of: DataFrame, max_gold: int = MAX_GOLD) -> DataFrame:
    """Questions about projects, and by way of agencies with one project; with the relations they rest on as ``sources``."""
    spark = home.sparkSession
    key = F.concat_ws("|", "head", "rtype", "tail")
    names = entities.select("eid", "name")
    ask1 = F.broadcast(spark.createDataFrame(list(REAL_ONE), "rtype string, template string"))
    one = (
        home.join(ask1, "rtype").join(names.withColumnRenamed("eid", "head"), "head")
        .select(fill(F.col("template"), F.col("name")).alias("question"), F.lit(1).alias("hops"), F.array("chunk_id").alias("gold"), F.array("head").alias("seeds"), F.array(key).alias("sources"))
    )
    issued = home.where("rtype = 'ISSUED_BY'")
    single = issued.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("project"), F.min("chunk_id").alias("issued_gold"), F.min(key).alias("issued_key")).where("n = 1").withColumnRenamed("tail", "agency")
    ask2 = F.broadcast(spark.createDataFrame(list(REAL_TWO), "rtype string, template string"))
    rows = home.join(ask2, "rtype").withColumn("key", key).join(single, F.col("head") == F.col("project"))
    grouped = rows.groupBy("agency", "rtype", "template", "issued_gold", "issued_key").agg(F.collect_set("chunk_id").alias("g"), F.array_sort(F.collect_list("key")).alias("k"))
    two = (
        grouped.join(names.withColumnRenamed("eid", "agency"), "agency")
        .select(
            fill(F.col("template"), F.col("name")).alias("question"), F.lit(2).alias("hops"), F.array_sort(F.array_union(F.array("issued_gold"), F.col("g"))).alias("gold"), F.array("agency").alias("seeds"),
            F.concat(F.array("issued_key"), F.col("k")).alias("sources"), F.concat_ws("|", "agency", "rtype").alias("key"),
        ).where(F.size("gold").between(2, max_gold))
    )
    anchored = shared_anchors(two.select(F.col("key").alias("qid"), "question", "gold"), entities, entities_of).select(F.col("qid").alias("key")).distinct()
    two = two.join(anchored, "key", "left_anti").drop("key")
    return finalize(one.unionByName(two), "r", 4)


def summary(queries: DataFrame) -> DataFrame:
    n = F.size("gold")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return queries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hops") == 1).alias("single_hop"), F.count_if(F.col("hops") == 2).alias("multi_hop"), zero(F.min(n)).alias("gold_min"), zero(F.max(n)).alias("gold_max"),
        F.coalesce(F.round(F.avg(n), 3), F.lit(0.0)).alias("gold_mean"),
    )


# Factors of altered amounts.
FACTORS = (0.5, 0.6, 0.75, 1.2, 1.5, 2.0)


def altered_amount(n: Column, forbidden: Column, seed: Column) -> Column:
    """A plausible other amount, in whole millions: the first factor, in an order set by ``seed``, that gives an unused number."""
    made = []
    for k in range(len(FACTORS)):
        f = F.element_at(F.array(*[F.lit(x) for x in FACTORS]), (F.pmod(seed + k, F.lit(len(FACTORS))) + 1).cast("int"))
        v = (F.round(n * f / 1_000_000).cast("long") * 1_000_000)
        v = F.when(v == 0, F.lit(10_000_000).cast("long")).otherwise(v)
        made.append(F.when((v != n) & ~F.array_contains(forbidden, v.cast("string")), v))
    return F.coalesce(*made)


def other_agencies(rows: DataFrame, agencies: DataFrame, seed: int = 0, tries: int = 4) -> DataFrame:
    """(project_id, other_agency): of each row (project_id, agency, all) an agency that is not its own and not named in ``all``.

    Agencies are numbered, and a row asks for the numbers behind one drawn by
    hash, ``tries`` of them and twice as many at each further turn, until one fits
    or all were asked. So a row meets few agencies, whatever their number; a row
    that no agency fits, or without its own, has no result.
    """
    known = cut(numbered(agencies.select(F.col("agency").alias("other_agency")).where("other_agency is not null").distinct(), ["other_agency"], "nth"))
    total, done, found = known.count(), 0, None
    left = rows.select("project_id", "agency", "all").where("agency is not null")
    while done < total:
        upto = min(done + tries, total)
        asked = F.transform(F.sequence(F.lit(done), F.lit(upto - 1)), lambda k: F.pmod(F.xxhash64("project_id", F.lit(seed)), F.lit(total)) + k)
        drawn = left.select("project_id", F.posexplode(asked).alias("turn", "at")).select("project_id", "turn", F.pmod("at", F.lit(total)).alias("nth"))
        names = drawn.join(known, "nth").groupBy("project_id").agg(F.sort_array(F.collect_set(F.struct("turn", "other_agency")))["other_agency"].alias("names"))
        fits = F.filter("names", lambda x: (x != F.col("agency")) & ~F.col("all").contains(x))
        met = cut(left.join(names, "project_id").withColumn("other_agency", F.get(fits, F.lit(0))).drop("names"))
        won = met.where("other_agency is not null").select("project_id", "other_agency")
        found = won if found is None else found.unionByName(won)
        left = met.where("other_agency is null").drop("other_agency")
        done, tries = upto, tries * 2
        if left.isEmpty():
            break
    return rows.select("project_id", F.col("agency").alias("other_agency")).limit(0) if found is None else found


def hallucination_items(facts: DataFrame, chunks: DataFrame, agencies: DataFrame, seed: int = 0, n_dev: int = 16) -> DataFrame:
    """Four answers of each amount, two true and two not.

    ``facts`` is (project_id, project_name, amount, doc_name, text, agency), kept
    where the text holds the amount as a number. Two chunks of other documents
    join the contexts, chosen by hash, as are the wrong agency and the 16 facts of
    split dev. Chunks are numbered by document, so the chunks of others are all
    numbers but one range, and a fact meets only the two that it draws.
    """
    good = facts.where(F.array_contains(number_set(F.col("text")), F.col("amount").cast("string")))
    good = good.where(F.col("doc_name").isNotNull())
    dev = good.select("project_id").orderBy(F.xxhash64("project_id", F.lit(seed)), "project_id").limit(n_dev).withColumn("split", F.lit("dev"))
    others = numbered(chunks.where(F.col("doc_name").isNotNull()).select("doc_name", F.col("text").alias("other_text"), "chunk_id"), ["doc_name", "chunk_id", "other_text"], "pos")
    total = others.count()
    own = others.groupBy("doc_name").agg(F.min("pos").alias("begin"), F.count(F.lit(1)).alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    draws = good.join(own, "doc_name", "left").select("project_id", zero("begin"), zero("size")).withColumn("room", F.lit(total) - F.col("size")).where("room > 0")
    one = F.pmod(F.xxhash64("project_id", F.lit(seed)), F.greatest("room", F.lit(1)))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("project_id", F.lit(seed + 2)), F.greatest(F.col("room") - 1, F.lit(1))), F.greatest("room", F.lit(1)))
    draws = draws.select("project_id", "begin", "size", F.posexplode(F.when(F.col("room") > 1, F.array(one, two)).otherwise(F.array(one))).alias("r", "nth"))
    few = draws.select("project_id", "r", F.when(F.col("nth") < F.col("begin"), F.col("nth")).otherwise(F.col("nth") + F.col("size")).alias("pos")).join(others.select("pos", "other_text"), "pos")
    extra = few.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("r", "other_text")))["other_text"].alias("distractors"))
    rows = cut(good.join(extra, "project_id").withColumn("contexts", F.concat(F.array("text"), F.col("distractors"))).withColumn("all", F.array_join("contexts", "\n")))
    rows = rows.join(other_agencies(rows, agencies, seed), "project_id")
    says = lambda amount: F.concat(F.col("project_name"), F.lit("의 사업 예산은 "), amount, F.lit("입니다."))
    exact = says(format_won(F.col("amount")))
    other = altered_amount(F.col("amount"), number_set(F.col("all")), F.pmod(F.xxhash64("project_id", F.lit(seed + 1)), F.lit(6)))
    variants = F.array(
        F.struct(F.lit("F-exact").alias("variant"), F.lit(0).alias("hallucinated"), exact.alias("answer")),
        F.struct(F.lit("F-para").alias("variant"), F.lit(0).alias("hallucinated"), says(korean_units(F.col("amount"))).alias("answer")),
        F.struct(F.lit("H-number").alias("variant"), F.lit(1).alias("hallucinated"), says(format_won(other)).alias("answer")),
        F.struct(F.lit("H-extra").alias("variant"), F.lit(1).alias("hallucinated"), F.concat(exact, F.lit(" 이 사업의 발주기관은 "), F.col("other_agency"), F.lit("입니다.")).alias("answer")),
    )
    rows = rows.join(F.broadcast(dev), "project_id", "left")  # n_dev rows
    items = rows.select("project_id", F.coalesce("split", F.lit("test")).alias("split"), F.concat(F.col("project_name"), F.lit("의 사업 예산은 얼마인가?")).alias("question"), "contexts", F.explode(variants).alias("v"))
    return items.select(F.concat_ws("|", "project_id", "v.variant").alias("item_id"), "project_id", "split", "v.variant", "v.hallucinated", "question", "v.answer", "contexts")
