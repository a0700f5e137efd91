"""Registered queries over the typed graph of the driver's tables, and the questions, statistics and audits on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import audit, evalset, graph, metrics, ontology, ranking, stats
from lodestar.plans.lineage import cut
from lodestar.plans.queries import contingency_sql, P_SQL, query, rounded, table, top_sql
from lodestar.sources import stores

REL = """rel AS (SELECT 'nation:' || c_nationkey AS head, 'CONTAINS' AS rtype, 'customer:' || c_custkey AS tail FROM customer
        UNION ALL SELECT 'region:' || n_regionkey, 'CONTAINS', 'nation:' || n_nationkey FROM nation
        UNION ALL SELECT 'nation:' || s_nationkey, 'SUPPLIED_BY', 'supplier:' || s_suppkey FROM supplier)"""
EDGE = "edge AS (SELECT head AS src, tail AS dst FROM rel UNION SELECT tail, head FROM rel)"


def eid(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def relations(spark, d) -> DataFrame:
    """Regions contain nations, nations contain customers and are supplied by suppliers."""
    row = lambda t, h, r, x: table(spark, d, t).select(h.alias("head"), F.lit(r).alias("rtype"), x.alias("tail"))
    return (
        row("customer", eid("nation", "c_nationkey"), "CONTAINS", eid("customer", "c_custkey"))
        .unionByName(row("nation", eid("region", "n_regionkey"), "CONTAINS", eid("nation", "n_nationkey")))
        .unionByName(row("supplier", eid("nation", "s_nationkey"), "SUPPLIED_BY", eid("supplier", "s_suppkey")))
    )


def entities(spark, d) -> DataFrame:
    r = relations(spark, d)
    return r.select(F.explode(F.array("head", "tail")).alias("eid")).distinct().select("eid", F.col("eid").alias("name"))


def seeds(spark, d) -> DataFrame:
    """Every supplier starts a search of its own."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), eid("supplier", "s_suppkey").alias("eid"))


SEED = "seed AS (SELECT s_suppkey AS qid, 'supplier:' || s_suppkey AS eid FROM supplier)"
DIST = """dist AS (WITH RECURSIVE w(qid, eid, dist) AS (SELECT qid, eid, 0 FROM seed UNION SELECT w.qid, edge.dst, w.dist + 1 FROM w JOIN edge ON w.eid = edge.src WHERE w.dist < 2)
        SELECT qid, eid, min(dist) AS dist FROM w GROUP BY qid, eid)"""


@query("graph_neighbors", f"WITH {REL} SELECT head AS eid, head, rtype, tail FROM rel UNION ALL SELECT tail, head, rtype, tail FROM rel")
def _(spark, d):
    return graph.neighbors(relations(spark, d), entities(spark, d))


@query("graph_expand", f"WITH {REL}, {EDGE}, {SEED}, {DIST} SELECT qid, eid, dist FROM dist")
def _(spark, d):
    return graph.expand(seeds(spark, d), relations(spark, d), 2)


@query("graph_expand_paths", f"WITH {REL}, {EDGE}, {SEED}, {DIST} SELECT qid, eid, dist FROM dist")
def _(spark, d):
    return graph.expand_paths(seeds(spark, d), relations(spark, d), 2)


@query("graph_expand_recursive", f"WITH {REL}, {EDGE}, {SEED}, {DIST} SELECT qid, eid, dist FROM dist")
def _(spark, d):
    return graph.expand_recursive(seeds(spark, d), relations(spark, d), 2)


@query("graph_backends_differ", "SELECT 0::BIGINT AS differences")
def _(spark, d):
    return graph.backends_differ(seeds(spark, d), relations(spark, d), 2).agg(F.count(F.lit(1)).alias("differences"))


@query("directed_edges", f"WITH {REL} SELECT head AS src, tail AS dst, rtype, true AS forward FROM rel UNION ALL SELECT tail, head, rtype, false FROM rel")
def _(spark, d):
    return graph.directed_edges(relations(spark, d)).select("src", "dst", "rtype", "forward")


_DIR = "de AS (SELECT head AS src, tail AS dst, rtype, true AS forward, head, tail FROM rel UNION ALL SELECT tail, head, rtype, false, head, tail FROM rel)"
_UNI = "un AS (SELECT src, rtype, forward FROM de GROUP BY ALL HAVING count(*) = 1)"


@query("unique_steps", f"WITH {REL}, {_DIR}, {_UNI} SELECT * FROM un")
def _(spark, d):
    return graph.unique_steps(graph.directed_edges(relations(spark, d)))


@query("adjacency", f"WITH {REL}, {EDGE} SELECT src AS eid, count(*) AS n, string_agg(dst, ' ' ORDER BY dst) AS neighbours FROM edge GROUP BY src")
def _(spark, d):
    return graph.adjacency(relations(spark, d)).select("eid", F.size("neighbours").cast("long").alias("n"), F.array_join("neighbours", " ").alias("neighbours"))


# a chunk is an order: it states who placed it and where that customer lives
_ORD = "cr AS (SELECT 'order:' || o_orderkey AS chunk_id, 'nation:' || c_nationkey AS head, 'CONTAINS' AS rtype, 'customer:' || c_custkey AS tail FROM orders JOIN customer ON o_custkey = c_custkey)"


def order_relations(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return o.select(eid("order", "o_orderkey").alias("chunk_id"), eid("nation", "c_nationkey").alias("head"), F.lit("CONTAINS").alias("rtype"), eid("customer", "c_custkey").alias("tail"))


@query("graph_mention_topk", f"""WITH {REL}, {EDGE}, {SEED}, {DIST}, {_ORD}, ce AS (SELECT chunk_id, head AS eid FROM cr UNION ALL SELECT chunk_id, tail FROM cr),
        sc AS (SELECT qid, chunk_id, 1.0e0 / (1 + min(dist)) + 0.01e0 * count(*) AS score FROM ce JOIN dist USING (eid) GROUP BY qid, chunk_id), {top_sql('sc', 5, 'best')} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM best""")
def _(spark, d):
    cr = order_relations(spark, d)
    ce = cr.select("chunk_id", F.explode(F.array("head", "tail")).alias("eid"))
    return rounded(ranking.reached_topk(seeds(spark, d), relations(spark, d), 2, ce, lambda dist: graph.mention_scores(dist, ce), 5), "score")


@query("graph_relation_topk", f"""WITH {REL}, {EDGE}, {SEED}, {DIST}, {_ORD},
        sc AS (SELECT h.qid, chunk_id, sum(1.0e0 / (1 + least(h.dist, t.dist))) AS score FROM cr JOIN dist h ON h.eid = head JOIN dist t ON t.eid = tail AND t.qid = h.qid GROUP BY h.qid, chunk_id), {top_sql('sc', 5, 'best')}
        SELECT qid, chunk_id, rank, round(score, 6) AS score FROM best""")
def _(spark, d):
    cr = order_relations(spark, d)
    ce = cr.select(F.explode(F.array("head", "tail")).alias("eid"))
    return rounded(ranking.reached_topk(seeds(spark, d), relations(spark, d), 2, ce, lambda dist: graph.relation_scores(dist, cr), 5), "score")


# searches start from suppliers' nations; flat scores are those of the customers that a supplier reaches
_FUSE = "fu{0} AS (SELECT qid, chunk_id, 0.5e0 * coalesce(a.score, 0) + 0.5e0 * coalesce(b.score, 0) AS score FROM fn{0} a FULL JOIN rn{0} b USING (qid, chunk_id))"
_NORMAL = "{1} AS (SELECT qid, chunk_id, score / max(score) OVER (PARTITION BY qid) AS score FROM {0})"
_NEAR = """di{0} AS (SELECT qid, eid, min(dist) AS dist FROM (SELECT qid, eid, 0 AS dist FROM sd{0} UNION ALL SELECT qid, dst, 1 FROM sd{0} JOIN edge ON eid = src) GROUP BY qid, eid),
        rs{0} AS (SELECT h.qid, chunk_id, sum(1.0e0 / (1 + least(h.dist, t.dist))) AS score FROM cr JOIN di{0} h ON h.eid = head JOIN di{0} t ON t.eid = tail AND t.qid = h.qid GROUP BY h.qid, chunk_id)"""
_ITER = f"""{REL}, {EDGE}, {SEED}, {DIST}, {_ORD}, sc AS (SELECT qid, chunk_id, 1.0e0 / (1 + min(dist)) + 0.01e0 * count(*) AS score FROM (SELECT chunk_id, tail AS eid FROM cr) JOIN dist USING (eid) GROUP BY qid, chunk_id),
        fl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc), {_NORMAL.format('fl', 'fn1')}, sd1 AS (SELECT s_suppkey AS qid, 'nation:' || s_nationkey AS eid FROM supplier), {_NEAR.format(1)}, {_NORMAL.format('rs1', 'rn1')}, {_FUSE.format(1)}, {top_sql('fu1', 3, 'b1')},
        ends AS (SELECT qid, unnest([head, tail]) AS near, unnest([tail, head]) AS far FROM b1 JOIN cr USING (chunk_id) WHERE rank = 1),
        sd2 AS (SELECT DISTINCT qid, far AS eid FROM ends WHERE (qid, near) IN (SELECT qid, eid FROM sd1) AND (qid, far) NOT IN (SELECT qid, eid FROM sd1)), {_NEAR.format(2)}, {_NORMAL.format('rs2', 'rn2')},
        fn2 AS (SELECT * FROM fn1 WHERE qid IN (SELECT qid FROM sd2)), {_FUSE.format(2)}, {top_sql('fu2', 3, 'b2')},
        al AS (SELECT qid, 1 AS round, rank, chunk_id FROM b1 UNION ALL SELECT qid, 2, rank, chunk_id FROM b2)"""
_PLACED = "pl AS (SELECT {1}, chunk_id, row_number() OVER (PARTITION BY {1} ORDER BY rank, round) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {1}, chunk_id ORDER BY rank, round) AS nth FROM {0}) WHERE nth = 1)"


def _iterated(spark, d, rounds=2):
    """Flat scores, rounds and trace of the queries that stand for those with the same of both, and (qid, like) of all."""
    cr = cut(order_relations(spark, d))
    ce, s, r = cr.select("chunk_id", F.col("tail").alias("eid")), seeds(spark, d), relations(spark, d)
    start = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), eid("nation", "s_nationkey").alias("eid"))
    begin = start.groupBy("qid").agg(F.array_sort(F.collect_set("eid")).alias("begin"))
    same = cut(graph.likened(graph.alike(s, r, ce).join(begin, "qid", "left")))
    flat = graph.mention_scores(graph.expand(graph.first_of(s, same), r, 2), ce)
    return flat, *ranking.iterate(graph.first_of(start, same), flat, r, cr, rounds=rounds, hops=1), same


@query("iterative_rounds", f"WITH {_ITER}, {_PLACED.format('al', 'qid')} SELECT * FROM pl WHERE rank <= 3")
def _(spark, d):
    _, found, _, same = _iterated(spark, d)
    return graph.to_all(ranking.interleave(found, 3), same)


@query("iterative_trace", f"WITH {_ITER} SELECT qid, max(round) AS rounds, count(*) AS retrieved, (SELECT count(*) FROM sd2 WHERE sd2.qid = al.qid) AS discovered FROM al GROUP BY qid")
def _(spark, d):
    _, found, trace, same = _iterated(spark, d)
    return graph.to_all(ranking.trace_summary(found, trace), same)


@query("round_budgets", f"""WITH {_ITER}, bu AS (SELECT unnest([1, 2, 3, 4]) AS budget), ab AS (SELECT budget, al.* FROM al, bu WHERE round <= budget), {_PLACED.format('ab', 'budget, qid')},
        us AS (SELECT budget, qid, max(round) AS used FROM ab GROUP BY budget, qid), li AS (SELECT budget, qid, list(chunk_id) AS r FROM pl WHERE rank <= 3 GROUP BY budget, qid), go AS (SELECT qid, list(chunk_id) AS gold FROM fl WHERE rank <= 2 GROUP BY qid)
        SELECT budget, round(avg((len(list_intersect(r, gold)) = len(gold))::INT), 6) AS full_hit, round(avg(used), 6) AS avg_rounds FROM li JOIN go USING (qid) JOIN us USING (budget, qid) GROUP BY budget""")
def _(spark, d):
    # an order states one relation, so no search has a third round: later budgets change nothing
    flat, found, _, same = _iterated(spark, d, 4)
    gold = ranking.top_k(flat, 2).groupBy("qid").agg(F.collect_list("chunk_id").alias("gold"))
    return rounded(ranking.sweep_rounds(graph.to_all(found, same), graph.to_all(gold, same), 3, 4), "full_hit", "avg_rounds")


@query("property_chain", "SELECT DISTINCT 'region:' || n_regionkey AS a, 'customer:' || c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").select(eid("nation", "n_nationkey").alias("head"), F.lit("IN").alias("rtype"), eid("region", "n_regionkey").alias("tail"))
    c = table(spark, d, "customer").select(eid("nation", "c_nationkey").alias("head"), F.lit("HAS").alias("rtype"), eid("customer", "c_custkey").alias("tail"))
    return graph.chain(n.unionByName(c), "IN", "HAS")


@query("inverse_relations", f"WITH {REL} SELECT tail AS head, CASE rtype WHEN 'CONTAINS' THEN 'WITHIN' ELSE 'SUPPLIES' END AS rtype, head AS tail FROM rel")
def _(spark, d):
    return graph.inverse(relations(spark, d), {"CONTAINS": "WITHIN", "SUPPLIED_BY": "SUPPLIES"})


@query("distinct_relations", "SELECT DISTINCT 'customer:' || o_custkey AS head, 'HAS_STATUS' AS rtype, 'status:' || o_orderstatus AS tail FROM orders")
def _(spark, d):
    return stores.distinct_relations(table(spark, d, "orders").select(eid("customer", "o_custkey").alias("head"), F.lit("HAS_STATUS").alias("rtype"), eid("status", "o_orderstatus").alias("tail")))


@query("rdf_triples", "SELECT DISTINCT 'urn:entity:part%3A' || p_partkey AS s, 'urn:relation:IS%20A' AS p, 'urn:entity:' || replace(url_encode(p_type || ' / ' || p_brand), '+', '%20') AS o FROM part")
def _(spark, d):
    return stores.as_triples(table(spark, d, "part").select(eid("part", "p_partkey").alias("head"), F.lit("IS A").alias("rtype"), F.concat_ws(" / ", "p_type", "p_brand").alias("tail")))


# ---- questions -------------------------------------------------------------

# a relation's home is the page of its tail
HOME = "home AS (SELECT head, rtype, tail, 'page:' || tail AS chunk_id FROM rel)"
CE = "ce AS (SELECT DISTINCT 'page:' || tail AS chunk_id, unnest([head, tail]) AS eid FROM rel)"


def homes(spark, d) -> DataFrame:
    return relations(spark, d).withColumn("chunk_id", F.concat(F.lit("page:"), F.col("tail")))


def page_entities(spark, d) -> DataFrame:
    return homes(spark, d).select("chunk_id", F.explode(F.array("head", "tail")).alias("eid")).distinct()


def _values(kind: str) -> str:
    rows = ", ".join(f"('{r}', {str(f).lower()}, '{t}')" for k, r, f, t in evalset.TEMPLATES if k == kind)
    return f"(VALUES {rows}) AS {kind}(rtype, forward, template)"


ONE = f"""one AS (SELECT replace(template, '{{a}}', src) AS question, 1 AS hops, gold, src AS seed FROM (SELECT src, rtype, forward, list(DISTINCT chunk_id ORDER BY chunk_id) AS gold FROM de JOIN home USING (head, rtype, tail) GROUP BY ALL)
        JOIN {_values('one')} USING (rtype, forward) WHERE len(gold) <= 3)"""
TWO = f"""hm AS (SELECT * FROM de JOIN home USING (head, rtype, tail)),
        fs AS (SELECT src, rtype AS r1, forward AS f1, dst AS via, chunk_id AS g1, template AS phrase FROM hm JOIN un USING (src, rtype, forward) JOIN {_values('phrase')} USING (rtype, forward)),
        mt AS (SELECT fs.src, r1, f1, hm.rtype AS r2, hm.forward AS f2, phrase, list_sort(list_distinct(list(g1) || list(chunk_id))) AS gold FROM fs JOIN hm ON hm.src = via WHERE dst <> fs.src AND dst <> via GROUP BY ALL),
        cand AS (SELECT src, r1, f1, r2, f2, replace(phrase, '{{a}}', src) || template AS question, gold FROM mt JOIN {_values('tail')} ON rtype = r2 AND forward = f2 WHERE len(gold) BETWEEN 2 AND 3),
        anch AS (SELECT src, r1, f1, r2, f2, question, eid FROM (SELECT *, unnest(gold) AS chunk_id FROM cand) JOIN ce USING (chunk_id) WHERE contains(question, eid) GROUP BY src, r1, f1, r2, f2, question, eid, gold HAVING count(DISTINCT chunk_id) = len(gold)),
        two AS (SELECT question, 2 AS hops, gold, src AS seed FROM cand ANTI JOIN anch USING (src, r1, f1, r2, f2))"""


def parts(spark, d):
    r = relations(spark, d)
    return graph.directed_edges(r), homes(spark, d), entities(spark, d), page_entities(spark, d), evalset.template_table(spark)


def flat(q: DataFrame, *more: str) -> DataFrame:
    return q.select("question", "hops", F.array_join("gold", " ").alias("gold"), F.get("seeds", F.lit(0)).alias("seed"), *more)


@query("one_hop_questions", f"WITH {REL}, {_DIR}, {HOME}, {ONE} SELECT question, hops, array_to_string(gold, ' ') AS gold, seed FROM one")
def _(spark, d):
    e, h, n, _, t = parts(spark, d)
    return flat(evalset.one_hop(e, h, n, t))


@query("two_hop_questions", f"WITH {REL}, {_DIR}, {_UNI}, {HOME}, {CE}, {TWO} SELECT question, hops, array_to_string(gold, ' ') AS gold, seed FROM two")
def _(spark, d):
    return flat(evalset.two_hop(*parts(spark, d)))


_NUM = f"{REL}, {_DIR}, {_UNI}, {HOME}, {CE}, {ONE}, {TWO}, al AS (SELECT * FROM one UNION ALL SELECT * FROM two), gen AS (SELECT 'g' || lpad((row_number() OVER (ORDER BY hops, question, gold))::VARCHAR, 9, '0') AS qid, * FROM al)"


def numbered(spark, d) -> DataFrame:
    e, h, n, ce, t = parts(spark, d)
    return evalset.finalize(evalset.one_hop(e, h, n, t).unionByName(evalset.two_hop(e, h, n, ce, t)), "g", 9)


@query("question_ids", f"WITH {_NUM} SELECT qid, question, hops FROM gen")
def _(spark, d):
    return numbered(spark, d).select("qid", "question", "hops")


@query("question_summary", f"WITH {_NUM} SELECT count(*) AS total, count(*) FILTER (hops = 1) AS single_hop, count(*) FILTER (hops = 2) AS multi_hop, min(len(gold)) AS gold_min, max(len(gold)) AS gold_max, round(avg(len(gold)), 3) AS gold_mean FROM gen")
def _(spark, d):
    return evalset.summary(numbered(spark, d))


@query("split_holdout", f"WITH {_NUM} SELECT qid, hops, CASE WHEN (row_number() OVER (PARTITION BY hops ORDER BY qid) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM gen")
def _(spark, d):
    return evalset.split_holdout(numbered(spark, d)).select("qid", "hops", "split")


@query("question_leaks", f"WITH {_NUM} SELECT qid, e.eid FROM gen JOIN (SELECT DISTINCT unnest([head, tail]) AS eid FROM rel) e ON contains(question, e.eid) WHERE hops >= 2 AND e.eid <> seed AND NOT contains(seed, e.eid)")
def _(spark, d):
    return evalset.leaks(numbered(spark, d), entities(spark, d))


@query("shared_anchors", f"""WITH {_NUM} SELECT qid, eid FROM (SELECT qid, question, gold, unnest(gold) AS chunk_id FROM gen) JOIN ce USING (chunk_id) WHERE contains(question, eid) GROUP BY qid, question, gold, eid HAVING count(DISTINCT chunk_id) = len(gold)""")
def _(spark, d):
    return evalset.shared_anchors(numbered(spark, d), entities(spark, d), page_entities(spark, d))


# ---- statistics ------------------------------------------------------------

_LAB = "lb AS (SELECT l.doc_id, lang, quality, toxic, n_chars FROM labels l JOIN documents d USING (doc_id))"


_TUNED = f"""oc AS (SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, quality = 1 AS a, toxic = 0 AS b, n_chars > 500 AS c FROM lb),
        pr AS (SELECT 'flat' AS s, 'tuned' AS t, a AS x, b AS y FROM oc WHERE split = 'test' UNION ALL SELECT 'flat', 'plain', a, c FROM oc)"""


@query("tuned_on_holdout", f"WITH {_LAB}, {_TUNED}, {contingency_sql('pr', 's, t')} SELECT s AS a, t AS b, n, a_only, b_only, round((b_only - a_only)::DOUBLE / n, 6) AS delta FROM ct")
def _(spark, d):
    """A strategy tuned on half of the questions is compared on the other half alone."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    says = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("correct")) for n, c in (("flat", F.col("quality") == 1), ("tuned", F.col("toxic") == 0), ("plain", F.col("n_chars") > 500))])
    rows = l.select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, "dev").otherwise(F.lit("test")).alias("split"), F.explode(says).alias("s")).select("qid", "split", "s.*")
    return rounded(stats.compare(rows, [("flat", "tuned"), ("flat", "plain")], ("tuned",)).select("a", "b", "n", "a_only", "b_only", "delta"), "delta")



def labelled(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


def label_outcomes(spark, d) -> DataFrame:
    """Two strategies: one is right on rows of good quality, the other on rows that aren't toxic."""
    l = labelled(spark, d)
    a = l.select("lang", F.col("doc_id").alias("qid"), F.lit("quality").alias("strategy"), (F.col("quality") == 1).alias("correct"))
    return a.unionByName(l.select("lang", F.col("doc_id").alias("qid"), F.lit("clean").alias("strategy"), (F.col("toxic") == 0).alias("correct")))


_CT = contingency_sql("(SELECT lang, quality = 1 AS x, toxic = 0 AS y FROM lb)", "lang")


@query("contingency_by_lang", f"WITH {_LAB}, {_CT} SELECT * FROM ct")
def _(spark, d):
    return stats.contingency(label_outcomes(spark, d), "quality", "clean", "lang")


@query("mcnemar_by_lang", f"""WITH {_LAB}, {_CT} SELECT lang, discordant, round(("both" + a_only)::DOUBLE / n, 6) AS acc_a, round(("both" + b_only)::DOUBLE / n, 6) AS acc_b, round((b_only - a_only)::DOUBLE / n, 6) AS delta, round({P_SQL}, 6) AS p,
        CASE WHEN discordant < 6 THEN '판정불가' WHEN {P_SQL} < 0.05 THEN '유의' ELSE '유의하지 않음' END AS verdict FROM ct""")
def _(spark, d):
    m = stats.mcnemar(label_outcomes(spark, d), "quality", "clean", "lang")
    return rounded(m.select("lang", "discordant", "acc_a", "acc_b", "delta", "p", stats.verdict(F.col("discordant"), F.col("p")).alias("verdict")), "acc_a", "acc_b", "delta", "p")


_W = "(p + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) {} 1.96e0 / (1 + 3.8416e0 / n) * sqrt(p * (1 - p) / n + 3.8416e0 / (4.0e0 * n * n))"


@query("wilson_by_lang", f"WITH {_LAB}, g AS (SELECT lang, count(*) AS n, sum(quality)::DOUBLE / count(*) AS p FROM lb GROUP BY lang) SELECT lang, n, round(greatest(0, {_W.format('-')}), 4) AS lo, round(least(1, {_W.format('+')}), 4) AS hi FROM g")
def _(spark, d):
    g = labelled(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", F.round(w["lo"], 4).alias("lo"), F.round(w["hi"], 4).alias("hi"))


@query("auroc_by_lang", f"""WITH {_LAB} SELECT a.lang, round(avg(CASE WHEN a.n_chars < b.n_chars THEN 1.0e0 WHEN a.n_chars = b.n_chars THEN 0.5e0 ELSE 0 END), 6) AS auroc FROM lb a JOIN lb b ON a.lang = b.lang AND a.quality = 1 AND b.quality <> 1 GROUP BY a.lang""")
def _(spark, d):
    return rounded(metrics.auroc(labelled(spark, d), "n_chars", "quality", "lang").where("auroc is not null"), "auroc")


@query("least_discordant", "SELECT p, min(n) AS n FROM (VALUES (0.05e0), (0.01e0), (0.001e0)) t(p), range(1, 101) r(n) WHERE pow(2.0e0, 1 - n) <= p GROUP BY p")
def _(spark, d):
    return spark.createDataFrame([(p, stats.least_discordant(p)) for p in (0.05, 0.01, 0.001)], "p double, n long")


# ---- audits ----------------------------------------------------------------


@query("audit_plan", f"WITH {REL}, p AS (SELECT split_part(tail, ':', 1) AS rtype, count(*) AS population FROM rel GROUP BY 1) SELECT rtype, population, CASE WHEN population <= 150 THEN 'census' ELSE 'sample' END AS mode, least(population, 150) AS k FROM p")
def _(spark, d):
    return audit.plan_audit(relations(spark, d).groupBy(F.split("tail", ":")[0].alias("rtype")).agg(F.count(F.lit(1)).alias("population")))


@query("systematic_sample", "WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE n <= 150 OR i IN (SELECT floor(k * (n::DOUBLE / 150)) FROM range(150) t(k), (SELECT count(*) AS n FROM customer))")
def _(spark, d):
    return audit.systematic_sample(table(spark, d, "customer"), 150, ["c_custkey"]).select("c_custkey")


@query("audit_precision", f"WITH {_LAB}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS ok, (count(*) FILTER (quality = 1))::DOUBLE / count(*) AS p FROM lb GROUP BY lang) SELECT lang, n, ok, round(p, 4) AS precision, round(greatest(0, {_W.format('-')}), 4) AS lo, round(least(1, {_W.format('+')}), 4) AS hi FROM g")
def _(spark, d):
    rows = labelled(spark, d).withColumn("label", F.when(F.col("quality") == 1, "ok").otherwise(F.lit("bad")))
    return rounded(audit.precision(rows, F.lit(True), "lang"), "precision", "lo", "hi", places=4)


# a query is a customer, its sources are its orders, and an order of status F is invalid
_PUR = "bad AS (SELECT DISTINCT o_custkey AS qid FROM orders WHERE o_orderstatus = 'F'), cl AS (SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT qid FROM bad))"


def _audited(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus")
    sources = o.groupBy("qid").agg(F.collect_list("key").alias("sources"))
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("qid")).join(sources, "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return queries, audit.invalid_keys(o.withColumn("label", F.when(F.col("o_orderstatus") == "F", "bad").otherwise(F.lit("ok"))))


@query("purify", f"WITH {_PUR} SELECT qid FROM cl")
def _(spark, d):
    return audit.purify(*_audited(spark, d)).select("qid")


@query("audit_before_after", f"""WITH {_PUR}, oc AS (SELECT c_custkey AS qid, 'rich' AS strategy, c_acctbal > 0 AS correct FROM customer UNION ALL SELECT c_custkey, 'auto', c_mktsegment = 'AUTOMOBILE' FROM customer),
        a AS (SELECT strategy, avg(correct::INT) AS before, count(*) AS na FROM oc GROUP BY strategy), b AS (SELECT strategy, avg(correct::INT) AS after, count(*) AS nb FROM oc JOIN cl USING (qid) GROUP BY strategy)
        SELECT strategy, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, na - coalesce(nb, 0) AS dropped FROM a LEFT JOIN b USING (strategy)""")
def _(spark, d):
    queries, invalid = _audited(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), "c_acctbal", "c_mktsegment")
    out = c.select("qid", F.lit("rich").alias("strategy"), (F.col("c_acctbal") > 0).alias("correct")).unionByName(c.select("qid", F.lit("auto").alias("strategy"), (F.col("c_mktsegment") == "AUTOMOBILE").alias("correct")))
    names = spark.createDataFrame([("rich",), ("auto",)], "strategy string")
    return rounded(audit.before_after(queries, invalid, out, names), "before", "after", "delta")


@query("duplicate_documents", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return audit.duplicate_documents(table(spark, d, "documents"))


# ---- rules -----------------------------------------------------------------

_PROJ = """pj AS (SELECT DISTINCT 'project:' || o_custkey AS head, 'ISSUED_BY' AS rtype, 'agency:' || o_orderpriority AS tail FROM orders WHERE o_orderstatus <> 'P' UNION SELECT DISTINCT 'project:' || o_custkey, 'HAS_BUDGET', 'budget:' || o_orderstatus FROM orders)"""


def projects(spark, d) -> DataFrame:
    """Customers as projects: issued by the priorities of their orders, with the statuses as budgets."""
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus <> 'P'").select(eid("project", "o_custkey").alias("head"), F.lit("ISSUED_BY").alias("rtype"), eid("agency", "o_orderpriority").alias("tail"))
    return a.unionByName(o.select(eid("project", "o_custkey").alias("head"), F.lit("HAS_BUDGET").alias("rtype"), eid("budget", "o_orderstatus").alias("tail"))).distinct()


@query("cardinality_violations", f"""WITH {_PROJ}, c AS (SELECT head AS focus, path, count(DISTINCT tail) FILTER (rtype = path) AS n FROM pj, (VALUES ('ISSUED_BY'), ('HAS_BUDGET'), ('HAS_PERIOD')) v(path) GROUP BY head, path)
        SELECT * FROM c WHERE n > 1 OR (path = 'ISSUED_BY' AND n < 1)""")
def _(spark, d):
    return ontology.cardinality_violations(projects(spark, d))


@query("inferred_types", f"WITH {_PROJ} SELECT DISTINCT head AS eid, 'project' AS class FROM pj UNION SELECT DISTINCT tail, CASE rtype WHEN 'ISSUED_BY' THEN 'agency' ELSE 'budget' END FROM pj")
def _(spark, d):
    return ontology.inferred_types(projects(spark, d))


@query("type_report", f"WITH {_PROJ} SELECT 'agrees' AS status, count(*) AS n FROM (SELECT head AS eid FROM pj UNION SELECT tail FROM pj)")
def _(spark, d):
    p = projects(spark, d)
    return ontology.type_report(p.select(F.explode(F.array("head", "tail")).alias("eid")), ontology.inferred_types(p))


# suppliers and customers share keys: as one class of parties some have two roles
@query("disjoint_violations", "SELECT 'party:' || s_suppkey AS eid, 'agency project' AS classes FROM supplier JOIN orders ON o_custkey = s_suppkey GROUP BY s_suppkey")
def _(spark, d):
    o = table(spark, d, "orders").select(eid("party", "o_custkey").alias("head"), F.lit("ISSUED_BY").alias("rtype"), F.lit("agency:x").alias("tail"))
    s = table(spark, d, "supplier").select(F.lit("project:x").alias("head"), F.lit("ISSUED_BY").alias("rtype"), eid("party", "s_suppkey").alias("tail"))
    return ontology.disjoint_violations(ontology.inferred_types(o.unionByName(s))).select("eid", F.array_join("classes", " ").alias("classes"))


_SAME = "ls AS (SELECT head, rtype, min(tail) AS a FROM pj GROUP BY head, rtype), sm AS (SELECT DISTINCT a, tail AS b FROM pj JOIN ls USING (head, rtype) WHERE tail <> a)"


@query("same_as", f"WITH {_PROJ}, {_SAME} SELECT a, b FROM sm")
def _(spark, d):
    return ontology.same_as(projects(spark, d))


_CLO = """ed AS (SELECT a AS u, b AS v FROM sm UNION SELECT b, a FROM sm), clo AS (WITH RECURSIVE w(u, v) AS (SELECT u, u FROM ed UNION SELECT w.u, ed.v FROM w JOIN ed ON w.v = ed.u) SELECT u AS eid, min(v) AS same FROM w GROUP BY u)"""


@query("same_as_closure", f"WITH {_PROJ}, {_SAME}, {_CLO} SELECT eid, same FROM clo")
def _(spark, d):
    return ontology.closure(ontology.same_as(projects(spark, d)))


@query("substituted_relations", f"WITH {_PROJ}, {_SAME}, {_CLO} SELECT DISTINCT coalesce(h.same, head) AS head, rtype, coalesce(t.same, tail) AS tail FROM pj LEFT JOIN clo h ON h.eid = head LEFT JOIN clo t ON t.eid = tail")
def _(spark, d):
    p = projects(spark, d)
    return ontology.substitute(p, ontology.closure(ontology.same_as(p)))


@query("inconsistencies", f"WITH {_PROJ}, {_SAME} SELECT a, b FROM sm WHERE a LIKE 'agency:%' AND b LIKE 'agency:%'")
def _(spark, d):
    return ontology.inconsistencies(ontology.same_as(projects(spark, d)))


# agencies of two customers each, for some also of a project; an agency has one office, an office one area: equal agencies make
# equal offices, and these equal areas
_TOWER = """tw AS (SELECT 'project:' || (c_custkey // 2) AS head, 'ISSUED_BY' AS rtype, 'agency:' || c_custkey AS tail FROM customer WHERE (c_custkey // 2) % 3 = 0
        UNION SELECT 'agency:' || c_custkey, 'HAS_OFFICE', 'office:' || (c_custkey * 3 // 4) FROM customer UNION SELECT 'office:' || (c_custkey * 3 // 4), 'HAS_AREA', 'area:' || (c_custkey * 3 // 4 // 3) FROM customer)"""


def _level(name: str, source: str, rtype: str) -> str:
    """Classes of the values of one functional property, after those of its subjects."""
    return f"""{name}p AS (SELECT a.tail AS u, b.tail AS v FROM {source} a JOIN {source} b ON a.head = b.head AND a.rtype = b.rtype AND a.tail <> b.tail WHERE a.rtype = '{rtype}'),
        {name}r(u, v) AS (SELECT u, v FROM {name}p UNION SELECT r.u, p.v FROM {name}r r JOIN {name}p p ON p.u = r.v),
        {name} AS (SELECT u AS eid, min(v) AS same FROM (SELECT u, v FROM {name}r UNION SELECT u, u FROM {name}r) GROUP BY u),
        {name}t AS (SELECT DISTINCT coalesce(h.same, head) AS head, rtype, coalesce(t.same, tail) AS tail FROM {source} LEFT JOIN {name} h ON h.eid = head LEFT JOIN {name} t ON t.eid = tail)"""


_TOWER_SQL = f"WITH RECURSIVE {_TOWER}, {_level('l1', 'tw', 'ISSUED_BY')}, {_level('l2', 'l1t', 'HAS_OFFICE')}, {_level('l3', 'l2t', 'HAS_AREA')}"
_FUNCTIONAL = ("ISSUED_BY", "HAS_OFFICE", "HAS_AREA")


def tower(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k)
    name = lambda kind, x: F.concat(F.lit(f"{kind}:"), F.floor(x).cast("string"))
    office = F.floor(k * 3 / 4)
    rows = lambda h, r, t: c.select(h.alias("head"), F.lit(r).alias("rtype"), t.alias("tail"))
    issued = c.where(F.floor(k / 2) % 3 == 0).select(name("project", k / 2).alias("head"), F.lit("ISSUED_BY").alias("rtype"), name("agency", k).alias("tail"))
    return issued.unionByName(rows(name("agency", k), "HAS_OFFICE", name("office", office))).unionByName(rows(name("office", office), "HAS_AREA", name("area", office / 3))).distinct()


@query("saturated_relations", f"{_TOWER_SQL} SELECT * FROM l3t")
def _(spark, d):
    return ontology.saturate(tower(spark, d), _FUNCTIONAL)[0]


@query("saturated_classes", f"{_TOWER_SQL} SELECT eid, same FROM l1 UNION ALL SELECT eid, same FROM l2 UNION ALL SELECT eid, same FROM l3")
def _(spark, d):
    return ontology.saturate(tower(spark, d), _FUNCTIONAL)[1]
