"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_extract, lang_id, ngram_join, pii, quality_rules, token_output, url_filter, warc
from .common import LOWER, UPPER, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.encode_table(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_table(table(spark, sf_dir, "pages"))
    # The digest of a response is taken anew from the payload that was read back.
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), n=4, percent=85, links=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymise_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), F.array_sort(F.array_distinct("pii.kind")).alias("kinds"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = lang_id.identify(docs, lang_id.train(docs))
    return rows.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    here = [
        op1_url_filter, op2_token_output, op3_quality_rules, op4_byte_bpe, op5_warc,
        op6_ngram_join, op7_decontaminate, op8_pii, op9_html_extract, op10_lang_id,
    ]
    return {f.__name__: f for f in here}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _sql_urls() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.DEFAULT_RULES)
    return rf"""WITH r(verdict, h, p) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, verdict DESC) AS n FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM x LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (page_id)"""


def _sql_quality() -> str:
    q = quality_rules
    quoted = lambda p: p.replace("'", "''")
    count = lambda p: f"len(regexp_extract_all(x, '{p}'))"
    phrases = " OR ".join(f"contains(lower(x), '{quoted(p)}')" for p in q.BOILERPLATE_PHRASES)
    fails = f"""(({count(q.SEPARATOR)} >= {q.MIN_SEPARATORS} AND {count(q.SEPARATOR)} * {q.WORDS_PER_SEPARATOR} >= {count(q.WORD)})
 OR ({count(q.DECORATED)} >= {q.MIN_DECORATED} AND {count(q.DECORATED)} * {q.DECORATED_ONE_IN} >= {count(q.WORD)})
 OR (NOT regexp_matches(x, '{q.MARK}') AND {count(q.WORD)} >= {q.MIN_UNMARKED})
 OR (({phrases}) AND {count(q.WORD)} <= {q.MAX_NOTICE_WORDS}))"""
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {q.WINDOW - 2}), lambda i: array_to_string(w[i:i + {q.WINDOW - 1}], ' '))) AS g, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {q.WINDOW}),
p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p, range(0, {q.WINDOW}) o(k) GROUP BY 1),
e AS (SELECT doc_id, t, w, l, list_filter(l, lambda x: regexp_matches(x, '{q.WORD}')) AS wl, list_filter(l, lambda x: NOT {fails}) AS k, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{q.SYMBOL}'))::BIGINT AS n_symbols,
 (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, length(array_to_string(l, '')) + 0 AS whole, length(array_to_string(k, '')) AS rest FROM e),
v AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (whole - rest) * 100 <= whole * {q.MAX_REMOVED_PERCENT} AS kept FROM v"""


def _sql_links(n: int, percent: int) -> str:
    """Components and links by a join of all sets; equal sets are one node."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) END AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM s),
nodes AS (SELECT k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS least, count(*) AS copies FROM k WHERE n > 0 GROUP BY k),
i AS (SELECT k, n, unnest(s) AS g FROM nodes),
c AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM i a JOIN i b ON a.g = b.g AND a.k != b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE c * 100 >= (na + nb - c) * {percent}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS k, min(least) AS least FROM r JOIN nodes ON b = k GROUP BY 1),
j AS (SELECT a AS k, sum(copies) AS links FROM e JOIN nodes ON b = k GROUP BY 1)
SELECT doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n = 0 THEN doc_id ELSE least(nodes.least, coalesce(m.least, nodes.least)) END AS component_id,
 CASE WHEN k.n = 0 THEN 0 ELSE nodes.copies - 1 + coalesce(j.links, 0) END::BIGINT AS n_links FROM k LEFT JOIN nodes USING (k) LEFT JOIN m USING (k) LEFT JOIN j USING (k)"""


_SQL_WARC = rf"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= {warc.MIN_REVISIT_BYTES} AND first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= {warc.MIN_REVISIT_BYTES} AND first != page_id THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; merges, networks, permutations and templates it can't."""
    return {
        "op1_url_filter": _sql_urls(),
        "op3_quality_rules": _sql_quality(),
        "op5_warc": _SQL_WARC,
        "op6_ngram_join": _sql_links(4, 85),
    }
