"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import ann, divergence, exact_dedup, langid, lm, mixing, ngram_join, packing, quality, search, sharding, simhash, warc
from lodestar.llm.runtime import documents


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), width=4, num=85, den=100)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 40)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(documents(spark, sf_dir), keep="largest")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.deduplicate(documents(spark, sf_dir, "pages"), least=0)
    return records


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=3, distance=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix": op2_mix,
    "op3_shards": op3_shards,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_lm": op6_lm,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_langid": op9_langid,
    "op10_ann": op10_ann,
    "op11_divergence": op11_divergence,
    "op12_search": op12_search,
    "op13_simhash": op13_simhash,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31), 1)), '')"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
             e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
             both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
             r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, b.y FROM r JOIN both_ways b ON b.x = r.v)
        SELECT u AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(v) AS component_id FROM r LEFT JOIN n ON n.doc_id = u GROUP BY u""",
    "op5_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, strlen(p.html) AS payload_bytes, {_BASE32.replace('html', 'p.html')} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to, url AS target_uri FROM p JOIN f ON p.html = f.html""",
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_FOLD} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    "op11_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLD} AS t FROM documents),
             w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
             v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
             n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
             p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                          1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
                   FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
             q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (any_value(n) + 2 * any_value(v)) AS q
                   FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) GROUP BY ALL),
             pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.f, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
                       LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
                       ON x.lang = g.lang AND x.x = g.source AND x.y = h.source),
             terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
             r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM r WHERE part = 'pair' OR rank <= 10""",
    "op12_search": rf"""
        WITH f AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE doc_id IS NOT NULL),
             d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM f WHERE len(t) > 0),
             s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
             p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
             w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
             x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
                   FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, r),
             o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT * FROM o WHERE rank <= 10""",
}
