"""Registered queries for text functions, extraction, pages, stores, answer metrics and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.needles import matches
from lodestar.operators import answers, chunking, dense, evalset, extract, metrics, ranking
from lodestar.plans.graph_queries import relations, REL
from lodestar.plans.lineage import cut
from lodestar.plans.queries import bm25_best, bm25_sql, chunks_of, gold_of, GOLD, query, questions, rounded, table, top_sql
from lodestar.sources import pages, stores

# ---- functions -------------------------------------------------------------


@query("answer_tokens", "SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[0-9a-z가-힣]+'), ' ') AS toks FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.answer_tokens(F.col("text")), " ").alias("toks"))


@query("text_functions", r"""SELECT item_id, left(text, 108) || CASE WHEN length(text) > 108 THEN '…' ELSE '' END AS short, regexp_replace(text, '\s+', '', 'g') AS bare, 'query: ' || text AS prefixed, replace('{a}의 사양은 무엇인가?', '{a}', left(text, 10)) AS question,
        instr(text, 'th') AS at, contains(text, 'the ') AS has, starts_with(text, 'Th') AS begins FROM benchmark""")
def _(spark, d):
    x = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", T.truncate(x, 108).alias("short"), T.without_space(x).alias("bare"), T.prefixed(x, "query: ").alias("prefixed"), T.fill(F.lit("{a}의 사양은 무엇인가?"), F.left(x, F.lit(10))).alias("question"),
        F.instr(x, "th").alias("at"), x.contains("the ").alias("has"), x.startswith("Th").alias("begins"),
    )


@query("iri_round_trip", "SELECT p_partkey, 'urn:entity:' || replace(url_encode(p_name || ' / ' || p_type || '#1'), '+', '%20') AS iri, p_name || ' / ' || p_type || '#1' AS back FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" / "), "p_type", F.lit("#1")).alias("eid"))
    return p.select("p_partkey", T.iri(F.col("eid")).alias("iri"), T.from_iri(T.iri(F.col("eid"))).alias("back"))


@query("file_names", "SELECT doc_id, source || '(' || lang || ')' AS agency, 'plan ' || doc_id || ' part_2' AS project FROM documents")
def _(spark, d):
    name = F.concat(F.lit("/in/"), "source", F.lit("（"), "lang", F.lit("）_plan  "), F.col("doc_id").cast("string"), F.lit("   part_2.hwp"))
    p = T.parse_filename(name)
    return table(spark, d, "documents").select("doc_id", p["agency"].alias("agency"), p["project"].alias("project"))


@query("amounts", r"""WITH o AS (SELECT o_orderkey, round(o_totalprice * 1000)::BIGINT AS n FROM orders), u AS (SELECT o_orderkey, n, n // 100000000 AS eok, (n % 100000000) // 10000 AS man, n % 10000 AS rest FROM o)
        SELECT o_orderkey, format('{:,}', n) || '원' AS won, concat_ws(' ', CASE WHEN eok > 0 THEN format('{:,}', eok) || '억' END, CASE WHEN man > 0 THEN format('{:,}', man) || '만' END, CASE WHEN rest > 0 THEN format('{:,}', rest) END) || ' 원' AS units,
        n AS parsed, n::VARCHAR AS number, format('{:,}', n) || '원' AS normalized FROM u""")
def _(spark, d):
    n = F.round(F.col("o_totalprice") * 1000).cast("long")
    o = table(spark, d, "orders").select("o_orderkey", T.format_won(n).alias("won"), T.korean_units(n).alias("units"))
    return o.select("o_orderkey", "won", "units", T.parse_won(F.concat(F.lit("금 "), "won")).alias("parsed"), F.get(T.number_set(F.col("won")), F.lit(0)).alias("number"), T.normalize_amounts(F.col("units")).alias("normalized"))


@query("context_windows", """WITH m AS (SELECT item_id, doc_id, d.text AS t, instr(d.text, b.text) - 1 AS s, length(b.text) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text))
        SELECT item_id, doc_id, s AS start, trim(replace(substr(t, greatest(0, s - 40) + 1, s + n + 40 - greatest(0, s - 40)), chr(10), ' ')) AS window FROM m""")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    m = matches(table(spark, d, "documents").select("doc_id", "text"), "text", b, "needle", first=True, pad=40)
    return m.select("item_id", "doc_id", "start", T.window_around(F.col("around"), F.col("at"), F.col("at") + F.length("needle")).alias("window"))


# ---- extraction: files written from orders ---------------------------------

#: A line that tells nothing, so long that it begins a chunk and the line after it still fits.
FILLER = "가나다라마바사아자차 " * 6 + "끝"
CHUNK = 100


def files(spark, d) -> DataFrame:
    """A file for each order: amounts, spans and techniques that count, and others that rules void."""
    k, n = F.col("o_orderkey"), F.round("o_totalprice").cast("long") * 1000
    s = lambda c: c.cast("string")
    money = F.when(k % 4 == 0, F.concat(F.lit("사업비 : "), F.format_number(n, 0), F.lit("원 (세금 포함)"))) \
        .when(k % 4 == 1, F.concat(F.lit("사업금액 "), s(k % 90 + 1), F.lit("억원 미만은 나눠서 맡긴다"))) \
        .when(k % 4 == 2, F.concat(F.lit("예산액 "), s(k % 900 + 100), F.lit(" 백만원 안팎이다"))) \
        .otherwise(F.concat(F.lit("배정예산 "), s(k % 90 + 1), F.lit(".5억원이다")))
    span = F.when(k % 4 == 0, F.concat(F.lit("용역기간 : 착수일로부터 "), s(k % 80 + 10), F.lit("일 이내"))) \
        .when(k % 4 == 1, F.concat(F.lit("계약기간 : 계약일로부터 "), s(k % 11 + 1), F.lit("개월"))) \
        .when(k % 4 == 2, F.concat(F.lit("납품 : "), s(k % 80 + 10), F.lit("일 이내"))) \
        .otherwise(F.concat(F.lit("사업기간 : 2031년 12월 "), s(k % 28 + 1), F.lit("일까지")))
    tech = F.when(F.col("o_orderstatus") == "O", "Oracle 저장소와 Docker 배포를 쓰는 장부 체계") \
        .when(F.col("o_orderstatus") == "F", "파이썬 사용은 제외. 도커 위에서 돌리는 수집과 정리 체계").otherwise(F.lit("JavaScript 화면과 통계를 갖춘 안내 체계 하나"))
    rule = F.when(k % 5 == 0, "적정 사업기간 산정기준 12개월 이내")
    text = F.concat_ws("\n", F.concat(F.lit("개요 문서 번호 "), s(k)), money, span, F.lit(FILLER), tech, rule)
    name = F.concat(F.when(k % 7 != 0, F.concat(F.lit("기관"), s(F.col("o_custkey")), F.lit("_"))).otherwise(F.lit("")), F.lit("사업"), s(k), F.lit(".hwp"))
    return table(spark, d, "orders").select(F.concat(F.lit("o"), s(k)).alias("doc_id"), name.alias("filename"), text.alias("text"))


FILE_SQL = rf"""f0 AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN '기관' || o_custkey END AS agency, '사업' || o_orderkey AS project, '개요 문서 번호 ' || o_orderkey AS head,
            CASE o_orderkey % 4 WHEN 0 THEN '사업비 : ' || format('{{:,}}', round(o_totalprice)::BIGINT * 1000) || '원 (세금 포함)' WHEN 1 THEN '사업금액 ' || (o_orderkey % 90 + 1) || '억원 미만은 나눠서 맡긴다'
                WHEN 2 THEN '예산액 ' || (o_orderkey % 900 + 100) || ' 백만원 안팎이다' ELSE '배정예산 ' || (o_orderkey % 90 + 1) || '.5억원이다' END AS money,
            CASE o_orderkey % 4 WHEN 0 THEN '용역기간 : 착수일로부터 ' || (o_orderkey % 80 + 10) || '일 이내' WHEN 1 THEN '계약기간 : 계약일로부터 ' || (o_orderkey % 11 + 1) || '개월'
                WHEN 2 THEN '납품 : ' || (o_orderkey % 80 + 10) || '일 이내' ELSE '사업기간 : 2031년 12월 ' || (o_orderkey % 28 + 1) || '일까지' END AS span,
            CASE o_orderstatus WHEN 'O' THEN 'Oracle 저장소와 Docker 배포를 쓰는 장부 체계' WHEN 'F' THEN '파이썬 사용은 제외. 도커 위에서 돌리는 수집과 정리 체계' ELSE 'JavaScript 화면과 통계를 갖춘 안내 체계 하나' END AS tech,
            CASE WHEN o_orderkey % 5 = 0 THEN '적정 사업기간 산정기준 12개월 이내' END AS rule FROM orders),
        fl AS (SELECT *, concat_ws(chr(10), head, money, span, '{FILLER}', tech, rule) AS text, [concat_ws(chr(10), head, money, span), concat_ws(chr(10), '{FILLER}', tech), rule] AS pages FROM f0),
        ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM fl),
        bu AS (SELECT doc_id, trim(regexp_extract(l, '[0-9,]+\s*백만\s*원|[0-9,]+(\.[0-9]+)?\s*억\s*원|[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}\s*원')) AS value FROM ln
               WHERE regexp_matches(l, '(사업비|예산액|배정예산|사업금액).*([0-9]\s*백만원|[0-9]억원|[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}원)') AND NOT regexp_matches(l, '미만|이상|초과|이하')),
        pe AS (SELECT doc_id, trim(regexp_extract(l, '계약일로부터 [0-9]+개월|[0-9]+개월 이내|[0-9]+일 이내|[0-9]+일까지')) AS value FROM ln WHERE regexp_matches(l, '기간.*[0-9](개월|일)') AND NOT regexp_matches(l, '적정') AND NOT regexp_matches(l, '월 [0-9]+일')),
        se AS (SELECT doc_id, trim(unnest(string_split(tech, '.'))) AS sentence FROM fl),
        fo AS (SELECT * FROM (VALUES ('Oracle', 'Oracle'), ('Docker', '도커'), ('Docker', 'Docker'), ('Python', '파이썬'), ('Java', 'Java'), ('JavaScript', 'JavaScript')) t(canon, form)),
        te AS (SELECT doc_id, canon, any_value(sentence) AS evidence FROM se JOIN fo ON contains(sentence, form) WHERE NOT contains(sentence, '제외') GROUP BY doc_id, canon),
        tr AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, tail) - 1 AS seq, project AS head, rtype, tail, part, evidence FROM (
            SELECT doc_id, 0 AS part, 'ISSUED_BY' AS rtype, agency AS tail, NULL AS evidence FROM fl WHERE agency IS NOT NULL UNION ALL SELECT doc_id, 1, 'HAS_BUDGET', value, NULL FROM bu
            UNION ALL SELECT doc_id, 2, 'HAS_PERIOD', value, NULL FROM pe UNION ALL SELECT doc_id, 3, 'REQUIRES', canon, evidence FROM te) JOIN fl USING (doc_id))"""
# evidence of amounts and spans is 40 characters on each side; without white space, it or its first half is looked for in the pages
HOME_SQL = r"""wi AS (SELECT tr.*, pages, regexp_replace(coalesce(evidence, substr(text, greatest(1, instr(text, tail) - 40), instr(text, tail) - greatest(1, instr(text, tail) - 40) + length(tail) + 40)), '\s+', '', 'g') AS need FROM tr JOIN fl USING (doc_id)),
        pg AS (SELECT doc_id, seq, list_transform(pages, lambda x: regexp_replace(x, '\s+', '', 'g')) AS hay FROM wi),
        pl AS (SELECT wi.*, CASE WHEN rtype = 'ISSUED_BY' THEN 0 ELSE coalesce(list_position(list_transform(hay, lambda h: contains(h, need)), true), list_position(list_transform(hay, lambda h: contains(h, left(need, greatest(8, length(need) // 2)))), true)) - 1 END AS page
            FROM wi JOIN pg USING (doc_id, seq)),
        ho AS (SELECT 'project:' || head AS head, rtype, CASE rtype WHEN 'ISSUED_BY' THEN 'agency:' WHEN 'REQUIRES' THEN 'tech:' WHEN 'HAS_BUDGET' THEN 'budget:' ELSE 'period:' END || tail AS tail, doc_id || '#c00' || page AS chunk_id, head AS project, tail AS name FROM pl WHERE page IS NOT NULL)"""


@query("extract_budgets", f"WITH {FILE_SQL} SELECT doc_id, value FROM bu")
def _(spark, d):
    return extract.budgets(files(spark, d)).select("doc_id", "value")


@query("extract_periods", f"WITH {FILE_SQL} SELECT doc_id, value FROM pe")
def _(spark, d):
    return extract.periods(files(spark, d)).select("doc_id", "value")


@query("extract_technologies", f"WITH {FILE_SQL} SELECT doc_id, canon, evidence FROM te")
def _(spark, d):
    return extract.technologies(files(spark, d), extract.alias_table(spark))


@query("technology_lists", f"WITH {FILE_SQL} SELECT doc_id, string_agg(canon, ' ' ORDER BY canon) AS techs FROM te GROUP BY doc_id")
def _(spark, d):
    return extract.technology_list(files(spark, d), extract.alias_table(spark)).select("doc_id", F.array_join("techs", " ").alias("techs"))


@query("document_triples", f"WITH {FILE_SQL} SELECT doc_id, seq, head, rtype, tail FROM tr")
def _(spark, d):
    return extract.build_triples(files(spark, d), extract.alias_table(spark)).select("doc_id", "seq", "head", "rtype", "tail")


@query("triple_summary", f"""WITH {FILE_SQL} SELECT (SELECT count(*) FROM fl) AS docs, count(*) AS triples, count(*) FILTER (rtype = 'ISSUED_BY') AS issued_by, count(*) FILTER (rtype = 'HAS_BUDGET') AS has_budget,
        count(*) FILTER (rtype = 'HAS_PERIOD') AS has_period, count(*) FILTER (rtype = 'REQUIRES') AS requires, count(DISTINCT CASE WHEN rtype = 'ISSUED_BY' THEN tail END) AS agencies, count(DISTINCT CASE WHEN rtype = 'REQUIRES' THEN tail END) AS techs,
        count(DISTINCT CASE WHEN rtype = 'HAS_BUDGET' THEN doc_id END) AS with_budget, count(DISTINCT CASE WHEN rtype = 'HAS_PERIOD' THEN doc_id END) AS with_period, round(count(*) FILTER (rtype = 'REQUIRES') / (SELECT count(*) FROM fl), 2) AS techs_per_doc FROM tr""")
def _(spark, d):
    f = files(spark, d)
    return extract.triple_summary(f, extract.build_triples(f, extract.alias_table(spark)))


def corpus(spark, d) -> dict[str, DataFrame]:
    aliases = extract.alias_table(spark)
    f = files(spark, d)
    return chunking.build_corpus(f, cut(extract.build_triples(f, aliases)), aliases, size=CHUNK, overlap=0)


@query("corpus_home", f"WITH {FILE_SQL}, {HOME_SQL} SELECT head, rtype, tail, chunk_id FROM ho")
def _(spark, d):
    return corpus(spark, d)["home"]


@query("corpus_summary", f"""WITH {FILE_SQL}, {HOME_SQL}, ck AS (SELECT doc_id, generate_subscripts(list_filter(pages, lambda x: x IS NOT NULL), 1) - 1 AS page FROM fl)
        SELECT (SELECT count(*) FROM ck) AS chunks, (SELECT count(*) FROM fl) AS docs, (SELECT count(*) FROM ck WHERE doc_id || '#c00' || page NOT IN (SELECT chunk_id FROM ho)) AS distractors, (SELECT count(*) FROM tr) AS relations,
        count(*) AS homes, (SELECT count(*) FROM (SELECT 'project:' || head FROM tr UNION SELECT rtype || tail FROM tr)) AS entities, count(*)::DOUBLE / (SELECT count(*) FROM tr) AS link_rate FROM ho""")
def _(spark, d):
    return chunking.corpus_summary(corpus(spark, d))


@query("real_questions", f"""WITH {FILE_SQL}, {HOME_SQL}, q1 AS (SELECT project || '의 사업 ' || CASE rtype WHEN 'HAS_BUDGET' THEN '예산은' ELSE '기간은' END || ' 얼마인가?' AS question, 1 AS hops, [chunk_id] AS gold FROM ho WHERE rtype IN ('HAS_BUDGET', 'HAS_PERIOD')),
        sg AS (SELECT tail, any_value(name) AS name, any_value(head) AS head, any_value(chunk_id) AS c FROM ho WHERE rtype = 'ISSUED_BY' GROUP BY tail HAVING count(*) = 1),
        q2 AS (SELECT sg.name || '이(가) 발주한 사업' || CASE rtype WHEN 'HAS_BUDGET' THEN '의 예산은 얼마인가?' WHEN 'HAS_PERIOD' THEN '의 기간은 얼마인가?' ELSE '은 어떤 기술을 요구하는가?' END AS question, 2 AS hops,
            list_sort(list_distinct(list_append(list(chunk_id), any_value(c)))) AS gold FROM ho JOIN sg USING (head) WHERE rtype <> 'ISSUED_BY' GROUP BY sg.name, rtype)
        SELECT 'r' || lpad(row_number() OVER (ORDER BY hops, question, gold)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY hops, question, gold)::VARCHAR))::INT, '0') AS qid, question, hops FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2 WHERE len(gold) BETWEEN 2 AND 3)""")
def _(spark, d):
    c = corpus(spark, d)
    entities_of = c["chunks"].select("chunk_id", F.explode("entities").alias("eid"))
    return evalset.real_questions(c["home"], c["entities"], entities_of).select("qid", "question", "hops")


# a question that names a second nation, which is not where it starts
@query("named_leaks", """WITH n AS (SELECT 'nation:' || n_nationkey AS eid, n_name AS name FROM nation), s AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN supplier ON s_suppkey = o_orderkey),
        q AS (SELECT a || '/' || b AS qid, 'who in ' || x.n_name || ' buys from ' || y.n_name AS question, 'nation:' || a AS seed, x.n_name AS seed_name FROM s JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b)
        SELECT qid, eid FROM q JOIN n ON contains(question, name) WHERE eid <> seed AND NOT contains(seed_name, name)""")
def _(spark, d):
    n = table(spark, d, "nation")
    nations = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("eid"), F.col("n_name").alias("name"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("s_suppkey"))
    pairs = orders.join(table(spark, d, "customer"), "c_custkey").join(table(spark, d, "supplier"), "s_suppkey").select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    named = pairs.join(n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), "a").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), "b")
    asked = named.select(
        F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("qid"), F.concat(F.lit("who in "), "x", F.lit(" buys from "), "y").alias("question"), F.lit(2).alias("hops"),
        F.array(F.concat(F.lit("nation:"), F.col("a").cast("string"))).alias("seeds"),
    )
    return evalset.leaks(asked, nations)


@query("hallucination_items")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("project_id"), F.concat(F.lit("사업"), F.col("o_orderkey").cast("string")).alias("project_name"), (F.round("o_totalprice").cast("long") * 1000).alias("amount"), F.col("o_custkey").cast("string").alias("doc_name"), F.col("o_orderpriority").alias("agency"),
    ).withColumn("text", F.concat(F.lit("사업비 "), T.format_won(F.col("amount"))))
    chunks = o.select("doc_name", "text", F.concat("doc_name", F.lit("#c000")).alias("chunk_id"))
    return evalset.hallucination_items(o, chunks, o.select("agency").distinct()).drop("contexts")


_NAMES = "nm AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 6)"


@query("entity_links", f"""WITH {_NAMES}, hit AS (SELECT item_id AS qid, name, row_number() OVER (PARTITION BY item_id ORDER BY length(name) DESC, name) AS o FROM benchmark JOIN nm ON contains(text, name))
        SELECT qid, name AS eid, name FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.qid = a.qid AND b.o < a.o AND contains(b.name, a.name))""")
def _(spark, d):
    q = questions(spark, d)
    names = q.select(F.explode(F.regexp_extract_all("question", F.lit("[a-z]+"), F.lit(0))).alias("name")).where(F.length("name") >= 6).distinct()
    return extract.link_entities(q, names.select(F.col("name").alias("eid"), "name"), 6)


# ---- corpus rendering ------------------------------------------------------


@query("rendered_corpus", f"""WITH {REL}, c AS (SELECT split_part(head, ':', 1) AS kind, head, tail, rtype FROM rel)
        SELECT head || '.pdf#p1' AS chunk_id, '[' || head || '] ' || string_agg(CASE rtype WHEN 'CONTAINS' THEN head || '은(는) ' || tail || '을(를) 포함한다.' ELSE head || '은(는) ' || tail || '에서 공급한다.' END, ' ' ORDER BY rtype, tail) AS text, count(*) AS states FROM c GROUP BY head""")
def _(spark, d):
    r = relations(spark, d).withColumn("rel_id", F.concat_ws("|", "head", "rtype", "tail"))
    plan = r.select(F.concat("head", F.lit(".pdf")).alias("doc_name"), F.lit(1).alias("page_num"), F.col("head").alias("title"), F.concat_ws("|", "rtype", "tail").alias("seq"), "rel_id")
    e = r.select(F.explode(F.array("head", "tail")).alias("eid")).distinct().select("eid", F.col("eid").alias("name"))
    return chunking.render_corpus(plan, r, e).select("chunk_id", "text", F.size("states").cast("long").alias("states"))


@query("relation_home", f"WITH {REL} SELECT head, rtype, tail, head || '.pdf#p1' AS chunk_id FROM rel")
def _(spark, d):
    r = relations(spark, d)
    states = F.collect_list(F.struct("head", "rtype", "tail")).alias("states")
    return chunking.relation_home(r.groupBy(F.concat("head", F.lit(".pdf#p1")).alias("chunk_id")).agg(states))


# ---- pages -----------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->)', '', 'g'), '(?i)(</(p|h[1-6]|li|div|tr|title)>|<br ?/?>)', chr(10), 'g'), '<[^>]*>', '', 'g')"
_CLEAN = f"array_to_string(list_filter(list_transform(string_split(regexp_replace(replace({_BARE}, chr(13), chr(10)), '[ \\t\u00a0]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query("clean_pages", f"SELECT page_id, {_CLEAN} AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean(pages.html_text(F.col("html"))).alias("text"))


@query("page_headings", "SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h[1-3][^>]*>([^<]*)</h[1-3]>', 1) AS h FROM pages)")
def _(spark, d):
    return pages.html_headings(table(spark, d, "pages"))


@query("marked_headings", f"""WITH c AS (SELECT page_id, string_split({_CLEAN}, chr(10)) AS l FROM pages), x AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS line_num, unnest(l) AS text FROM c)
        SELECT page_id, line_num, CASE WHEN 1000.0e0 / (10 + length(text)) > 1.2e0 * avg(1000.0e0 / (10 + length(text))) OVER (PARTITION BY page_id) THEN '## ' || text ELSE text END AS text FROM x""")
def _(spark, d):
    lines = table(spark, d, "pages").select(F.col("page_id").alias("doc_name"), F.posexplode(F.split(T.clean(pages.html_text(F.col("html"))), "\n")).alias("line_num", "text"))
    sized = lines.withColumn("size", F.lit(1000.0) / (10 + F.length("text")))  # short lines stand for large type
    return pages.mark_headings(sized).select(F.col("doc_name").alias("page_id"), "line_num", "text")


_TYPE = "CASE WHEN tl > n * 0.5 THEN 'table_heavy' WHEN n > 200 THEN 'text_heavy' ELSE 'mixed' END"


@query("content_types", f"WITH c AS (SELECT page_id, length({_CLEAN}) AS n, page_id % 3 * 300 AS tl FROM pages) SELECT {_TYPE} AS content_type, count(*) AS n, round(avg(n), 6) AS mean_chars, round(avg((tl > 0)::INT), 6) AS with_table FROM c GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages").select(F.length(T.clean(pages.html_text(F.col("html")))).alias("char_count"), (F.col("page_id") % 3 * 300).alias("tl"))
    return rounded(metrics.content_summary(p.select("char_count", pages.content_type(F.col("tl"), F.col("char_count")).alias("content_type"), (F.col("tl") > 0).alias("has_table"))), "mean_chars", "with_table")


@query("markdown_tables", """WITH w AS (SELECT n_regionkey, greatest(4, max(length(n_name))) AS a, greatest(3, max(length(n_nationkey::VARCHAR))) AS b FROM nation GROUP BY n_regionkey)
        SELECT n_regionkey, '| ' || rpad('name', max(a)::INT, ' ') || ' | ' || rpad('key', max(b)::INT, ' ') || ' |' || chr(10) || '| ' || repeat('-', max(a)::INT) || ' | ' || repeat('-', max(b)::INT) || ' |' || chr(10)
        || string_agg('| ' || rpad(n_name, a::INT, ' ') || ' | ' || rpad(n_nationkey::VARCHAR, b::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation JOIN w USING (n_regionkey) GROUP BY n_regionkey""")
def _(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("r"))))["r"].alias("r"))
    return rows.select("n_regionkey", pages.table_markdown(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.col("r"))).alias("md"))


# ---- stores ----------------------------------------------------------------


@query("store_upsert", "SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    held, new = docs.select("chunk_id", F.lit(1).alias("version")), docs.where("lang = 'en'").select("chunk_id", F.lit(2).alias("version"))
    return stores.upsert(held, new)


@query("store_get", "SELECT doc_id AS chunk_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return stores.get(docs, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")))


@query("encode_missing", "SELECT doc_id AS chunk_id, CASE WHEN vec_id IS NULL THEN 2 ELSE len(embedding)::INT END AS dim FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(spark, d):
    import numpy as np

    docs = chunks_of(spark, d)
    cache = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    out = dense.encode_missing(docs, cache, lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32))
    return out.select("chunk_id", F.size("v").alias("dim"))


# ---- answer metrics --------------------------------------------------------

_TURNS = "tn AS (SELECT u.conv_id, u.turn, u.text AS a, s.text AS b FROM conversations u JOIN conversations s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 WHERE u.role = 'user' AND s.role = 'assistant')"
_F1 = """ta AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[0-9a-z가-힣]+')) AS tok FROM tn) GROUP BY ALL), tb AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[0-9a-z가-힣]+')) AS tok FROM tn) GROUP BY ALL),
        bo AS (SELECT conv_id, turn, sum(least(ta.n, tb.n)) AS shared FROM ta JOIN tb USING (conv_id, turn, tok) GROUP BY conv_id, turn)
        SELECT conv_id, turn, round(coalesce(2.0e0 * shared / (len(regexp_extract_all(lower(a), '[0-9a-z가-힣]+')) + len(regexp_extract_all(lower(b), '[0-9a-z가-힣]+'))), 0), 6) AS f1 FROM tn LEFT JOIN bo USING (conv_id, turn)"""


def turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    u, s = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return u.join(s, ["conv_id", "turn"])


@query("token_f1_turns", f"WITH {_TURNS}, {_F1}")
def _(spark, d):
    return rounded(turns(spark, d).select("conv_id", "turn", metrics.token_f1(F.col("a"), F.col("b")).alias("f1")), "f1")


@query("token_f1_joined", f"WITH {_TURNS}, {_F1}")
def _(spark, d):
    pairs = turns(spark, d).select(F.struct("conv_id", "turn").alias("pair_id"), "a", "b")
    return rounded(metrics.token_f1_rows(pairs).select("pair_id.conv_id", "pair_id.turn", "f1"), "f1")


_REL = "rv AS (SELECT conv_id, list(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END ORDER BY turn) AS r FROM conversations GROUP BY conv_id)"


@query("context_precision", f"""WITH {_REL}, x AS (SELECT conv_id, r, generate_subscripts(r, 1) AS k, unnest(r) AS v FROM rv), y AS (SELECT conv_id, k, v, sum(v) OVER (PARTITION BY conv_id ORDER BY k) AS h FROM x)
        SELECT conv_id, round(coalesce(sum(CASE WHEN v > 0 THEN h::DOUBLE / k END) / nullif(sum(v), 0), 0), 6) AS cp FROM y GROUP BY conv_id""")
def _(spark, d):
    rel = F.when(F.col("role") == "assistant", 1).otherwise(0)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", rel.alias("r"))))["r"].alias("r"))
    return rounded(c.select("conv_id", metrics.context_precision(F.col("r")).alias("cp")), "cp")


@query("recall_and_faithfulness", f"WITH {_REL} SELECT conv_id, round(list_avg(r), 6) AS recall, coalesce(round(list_avg(list_filter(r, lambda x: x > 0)), 6), 1.0e0) AS faithfulness, coalesce(round(list_avg(list_filter(r, lambda x: x > 0)), 6), 0.0e0) AS found FROM rv")
def _(spark, d):
    rel = F.when(F.col("role") == "assistant", 1).otherwise(0)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(rel).alias("r"))
    some = F.filter("r", lambda x: x > 0)
    return rounded(c.select("conv_id", metrics.context_recall(F.col("r")).alias("recall"), metrics.faithfulness(some).alias("faithfulness"), metrics.context_recall(some).alias("found")), "recall", "faithfulness", "found")


_JUDGE = "jr AS (SELECT l.doc_id AS item_id, lang AS variant, toxic AS hallucinated, (quality = 0)::INT AS flagged, n_chars / 100.0e0 AS score, n_chars::DOUBLE AS ms FROM labels l JOIN documents d USING (doc_id))"


def judge_rows(spark, d) -> DataFrame:
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return l.select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("variant"), F.col("toxic").alias("hallucinated"), (F.col("quality") == 0).cast("int").alias("flagged"), (F.col("n_chars") / 100.0).alias("score"), F.col("n_chars").cast("double").alias("ms"), F.lit(None).cast("string").alias("error"),
    )


@query("judge_summary", f"""WITH {_JUDGE}, au AS (SELECT avg(CASE WHEN a.score < b.score THEN 1.0e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) AS auroc FROM jr a, jr b WHERE a.hallucinated = 1 AND b.hallucinated <> 1)
        SELECT count(*) AS n, round((count(*) FILTER (hallucinated = 1 AND flagged = 1))::DOUBLE / count(*) FILTER (hallucinated = 1), 6) AS recall, round((count(*) FILTER (hallucinated = 0 AND flagged = 1))::DOUBLE / count(*) FILTER (hallucinated = 0), 6) AS false_alarm,
        round((count(*) FILTER (hallucinated = 1 AND flagged = 1))::DOUBLE / count(*) FILTER (flagged = 1), 6) AS precision, round((SELECT auroc FROM au), 6) AS auroc, 0::BIGINT AS errors, list_sort(list(ms))[(count(*) // 2) + 1] AS p50 FROM jr""")
def _(spark, d):
    return rounded(metrics.judge_summary(judge_rows(spark, d)), "recall", "false_alarm", "precision", "auroc")


@query("judge_by_variant", f"WITH {_JUDGE} SELECT variant, count(*) AS n, sum(flagged)::BIGINT AS flagged, round(avg(score), 3) AS mean_score FROM jr GROUP BY variant")
def _(spark, d):
    return metrics.judge_by_variant(judge_rows(spark, d))


@query("judge_flips", f"WITH {_JUDGE} SELECT count(*) AS items, count(*) FILTER (flagged <> hallucinated) AS flips FROM jr")
def _(spark, d):
    j = judge_rows(spark, d)
    return metrics.flips(j, j.withColumn("flagged", F.col("hallucinated")))


@query("latency_elements", "WITH g AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v) AS n, round(m, 6) AS mean, v[least(floor(len(v) * 0.5e0)::INT, len(v) - 1) + 1] AS p50, v[least(floor(len(v) * 0.95e0)::INT, len(v) - 1) + 1] AS p95 FROM g")
def _(spark, d):
    return rounded(metrics.at_share(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type"), "mean")


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _(spark, d):
    return rounded(metrics.percentiles(table(spark, d, "events"), "value", "event_type"), "p50", "p95")


@query("count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.count_by(table(spark, d, "events"), "event_type")


# ---- answers ---------------------------------------------------------------


def _best(spark, d) -> DataFrame:
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), F.lit(0).alias("page_num"), "text")
    return bm25_best(spark, d, 2).join(meta, "chunk_id")


_BEST = f"{bm25_sql('okapi')}, {top_sql('bm', 2, 'best')}, bt AS (SELECT qid, rank, source, d.text AS t FROM best JOIN documents d ON doc_id = chunk_id)"


@query("assembled_contexts", f"WITH {_BEST} SELECT qid, string_agg('[문서 ' || rank || ': ' || source || ' / 페이지 1]' || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM bt GROUP BY qid")
def _(spark, d):
    return answers.assemble_context(_best(spark, d))


@query("rule_answers", f"WITH {_BEST} SELECT b.item_id AS qid, coalesce('[' || source || ' / 페이지 1] 관련 내용:' || chr(10) || chr(10) || left(t, 600) || chr(10) || chr(10) || '(※ Ollama 미연결 — Rule-based 폴백)', '관련 문서를 찾을 수 없습니다.') AS answer FROM benchmark b LEFT JOIN bt ON qid = item_id AND rank = 1")
def _(spark, d):
    return answers.rule_answers(questions(spark, d), _best(spark, d))


_CLAIM = "cl AS (SELECT conv_id, turn, a, b, list_filter(list_transform(regexp_split_to_array(b, '[.。]'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS c FROM tn)"


@query("stub_faithfulness", rf"WITH {_TURNS}, {_CLAIM} SELECT conv_id, turn, len(c) AS claims, round(CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: contains(a, regexp_split_to_array(x, '\s+')[1])))::DOUBLE / len(c) ELSE 1 END, 6) AS faithfulness FROM cl")
def _(spark, d):
    rows = turns(spark, d).select("conv_id", "turn", F.col("b").alias("answer"), F.array("a").alias("contexts"))
    return rounded(answers.stub_faithfulness(rows).select("conv_id", "turn", F.size("claims").alias("claims"), "faithfulness"), "faithfulness")


@query("judged_faithfulness", rf"WITH {_TURNS}, {_CLAIM} SELECT conv_id || '/' || turn AS item_id, len(c) AS claims, len(list_filter(c, lambda x: contains(a, regexp_split_to_array(x, '\s+')[1]))) AS supported, round(CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: contains(a, regexp_split_to_array(x, '\s+')[1])))::DOUBLE / len(c) ELSE 1 END, 6) AS faithfulness FROM cl")
def _(spark, d):
    rows = turns(spark, d).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), F.col("b").alias("answer"), F.array("a").alias("contexts"))
    return rounded(answers.judged_faithfulness(rows, lambda statement, context: statement.split()[0] in context), "faithfulness")


@query("find_document", f"WITH {FILE_SQL} SELECT doc_id, seq, head, rtype, tail FROM tr WHERE doc_id = (SELECT min(doc_id) FROM fl WHERE contains(project, '사업12') OR contains(agency, '사업12'))")
def _(spark, d):
    f = files(spark, d)
    p = T.parse_filename(F.col("filename"))
    docs = f.select("doc_id", p["agency"].alias("agency"), p["project"].alias("project"))
    return answers.find_document(docs, extract.build_triples(f, extract.alias_table(spark)), "사업12").drop("evidence")


@query("result_badges", f"""WITH {bm25_sql('okapi')}, {top_sql('bm', 3, 'best')}, {GOLD} SELECT qid, rank, chunk_id, CASE WHEN gold IS NULL THEN 'unlabelled' WHEN list_contains(gold, chunk_id) THEN 'gold' WHEN lang <> 'en' THEN 'distractor' ELSE 'wrong' END AS badge
        FROM best LEFT JOIN gold USING (qid) JOIN documents ON doc_id = chunk_id""")
def _(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "en", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("states"))
    return answers.badges(bm25_best(spark, d, 3), gold_of(spark, d), c)
