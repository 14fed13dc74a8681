"""Queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import curate, evaluate, ranking
from . import more, profiles, shapes

#: The queries of one text ask for benchmark item 0, those of all (``..._each``) for every id that this divides.
QUERY_ITEM = 0
EACH = 50


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").where(F.col("item_id") == QUERY_ITEM).select("text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").where(F.col("item_id") % EACH == 0).select("item_id", "text")


def bm25_corpus_topk(spark, sf_dir):
    return ranking.top_k(ranking.bm25_corpus(_t(spark, sf_dir, "documents"), _item(spark, sf_dir)), 20)


def bm25_pair_coverage(spark, sf_dir):
    return ranking.bm25_pair(_t(spark, sf_dir, "documents"), _item(spark, sf_dir))


def bm25_corpus_topk_each(spark, sf_dir):
    return ranking.top_k(ranking.bm25_corpus(_t(spark, sf_dir, "documents"), _items(spark, sf_dir), query_col="item_id"), 20, by="item_id")


def bm25_pair_coverage_each(spark, sf_dir):
    return ranking.bm25_pair(_t(spark, sf_dir, "documents"), _items(spark, sf_dir), query_col="item_id")


def clean_documents(spark, sf_dir):
    clean = text.clean_text(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("bigint").alias("clean_chars"))


def clean_pages_html(spark, sf_dir):
    clean = text.strip_markup(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("bigint").alias("clean_chars"))


def length_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id", F.length("text").cast("bigint").alias("chars"))


def exact_dedupe(spark, sf_dir):
    return curate.exact_dedupe(_t(spark, sf_dir, "documents"))


def priority_dedupe(spark, sf_dir):
    parts = [("benchmark", "item_id", 0), ("documents", "doc_id", 1), ("conversations", "conv_id", 2)]
    rows = [_t(spark, sf_dir, n).select(F.lit(p).alias("p"), F.col(i).alias("id"), "text") for n, i, p in parts]
    return curate.priority_dedupe(rows[0].unionByName(rows[1]).unionByName(rows[2]), "p", "id")


def gate_reasons(spark, sf_dir):
    return curate.gate_reasons(_t(spark, sf_dir, "documents"))


def _candidates(spark, sf_dir):
    """Customers as candidates: orders are their roles and projects."""
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("done")
    )
    rows = _t(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return rows.select("c_custkey", "c_mktsegment", zero(F.col("n")).alias("n"), zero(F.col("urgent")).alias("urgent"), zero(F.col("done")).alias("done"))


def _scores():
    n, urgent, done = F.col("n"), F.col("urgent"), F.col("done")
    return {
        "experience": scoring.experience(n * 4), "projects": scoring.projects(done, urgent), "skills": scoring.skills(n),
        "certifications": scoring.counted(urgent, 2, 10), "languages": scoring.languages(done), "leadership": scoring.counted(urgent, 2, 5),
    }


def rubric_scores(spark, sf_dir):
    scores = _scores()
    total = scoring.total(scores)
    return _candidates(spark, sf_dir).select("c_custkey", *[c.cast("int").alias(k) for k, c in scores.items()], total.alias("total_score"), scoring.label(total).alias("label"), scoring.borderline(total).alias("borderline"))


def label_distribution(spark, sf_dir):
    return rubric_scores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("total_score"), 4).alias("mean_score"), F.round(F.stddev_samp("total_score"), 4).alias("std_score"))


def weakest_sections(spark, sf_dir):
    return _candidates(spark, sf_dir).select("c_custkey", F.array_join(scoring.weakest(_scores(), most=3), ",").alias("weakest"))


def score_histogram(spark, sf_dir):
    rows = rubric_scores(spark, sf_dir)
    return rows.groupBy(F.least(F.floor(F.col("total_score") / 5), F.lit(19)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def cosine_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = rows.crossJoin(F.broadcast(query)).select("vec_id", scoring.similarity(F.col("embedding"), F.col("q")).alias("score"))
    return ranking.top_k(scored, 20, id_col="vec_id")


def cosine_topk_each(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    query = rows.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    similar = lambda block: rows.crossJoin(F.broadcast(block)).select("query_id", "vec_id", scoring.similarity(F.col("embedding"), F.col("q")).alias("score"))
    best = [ranking.top_k(similar(block), 20, id_col="vec_id", by="query_id") for block in ranking.query_blocks(query, "query_id", "q")]
    return reduce(DataFrame.unionByName, best)


def hybrid_blend_rank(spark, sf_dir):
    """Documents by lexical coverage, term overlap and a length rubric."""
    docs = _t(spark, sf_dir, "documents")
    pair = ranking.bm25_pair(docs, _item(spark, sf_dir)).withColumnRenamed("score", "lexical")
    rows = docs.select("doc_id", F.least(F.lit(100), F.floor(F.length("text") / 50)).alias("rubric")).join(pair, "doc_id")
    return ranking.top_k(rows.select("doc_id", scoring.blend(F.col("lexical"), F.col("lexical"), F.col("rubric")).alias("score")), 20)


def hybrid_blend_rank_each(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("rubric", F.least(F.lit(100), F.floor(F.length("text") / 50)))
    pair = ranking.bm25_pair(docs, _items(spark, sf_dir), query_col="item_id").withColumnRenamed("score", "lexical")
    rows = docs.select("doc_id", "rubric").join(pair, "doc_id")
    return ranking.top_k(rows.select("item_id", "doc_id", scoring.blend(F.col("lexical"), F.col("lexical"), F.col("rubric")).alias("score")), 20, by="item_id")


def skill_search_all(spark, sf_dir):
    rows = ranking.term_search(_t(spark, sf_dir, "documents"), ["ering", "thing", "tion"], True)
    return rows.select("doc_id", F.array_join("matched", ",").alias("matched"))


def skill_search_any(spark, sf_dir):
    rows = ranking.term_search(_t(spark, sf_dir, "documents"), ["ering", "thing", "tion"], False)
    return rows.select("doc_id", F.array_join("matched", ",").alias("matched"), F.array_join("unmatched", ",").alias("unmatched"))


def text_macro_features(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.macro_features(F.col("text")).items()])


def extract_contacts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.contacts(F.col("text")).items()])
    return rows.where("email != '' OR linkedin != ''")


def extract_contacts_all(spark, sf_dir):
    """Every document, also those with a phone number only or with no contact."""
    return _t(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.contacts(F.col("text")).items()])


def _judged(spark, sf_dir):
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")


def confusion_metrics(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("quality", (F.col("n_chars") >= 1000).cast("int").alias("guess"))
    return evaluate.class_metrics(rows, "quality", "guess")


def spearman_ties(spark, sf_dir):
    return evaluate.spearman(_judged(spark, sf_dir), "n_chars", "quality")


def ndcg_at_10(spark, sf_dir):
    return evaluate.ndcg(_judged(spark, sf_dir), "source", "quality", "n_chars", "doc_id")


def blend_grid_search(spark, sf_dir):
    rows = _judged(spark, sf_dir).select((F.col("n_chars") / 1000.0).alias("a"), F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("b"), F.col("quality").cast("double").alias("y"))
    return evaluate.blend_grid(rows, "a", "b", "y")


def population_stats(spark, sf_dir):
    return evaluate.population(_t(spark, sf_dir, "documents"), ["text", "lang"], "source")


def pivot_first(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.min("event_id"))


def last_write_wins(spark, sf_dir):
    return curate.upsert(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts")


def hash_split(spark, sf_dir):
    rows = curate.hash_split(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", {"test": 75, "val": 75, "train": 850})
    return rows.groupBy("split", "lang").agg(F.count("*").alias("n"))


def oversample_counts(spark, sf_dir):
    return curate.oversample(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"es": 6, "de": 3}).groupBy("lang").agg(F.count("*").alias("n"))


def near_leaks(spark, sf_dir):
    pool = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return curate.near_leaks(pool, pool.where(F.col("id") % 50 == 0)).where("a_id != b_id")


def event_islands(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return curate.islands(rows, "user_id", "event_id", "event_type")


_QUERIES = (
    bm25_corpus_topk, bm25_pair_coverage, clean_documents, clean_pages_html, length_filter, exact_dedupe, priority_dedupe, gate_reasons,
    rubric_scores, label_distribution, weakest_sections, score_histogram, cosine_topk, hybrid_blend_rank, skill_search_all, skill_search_any,
    text_macro_features, extract_contacts, confusion_metrics, spearman_ties, ndcg_at_10, blend_grid_search, population_stats,
    pivot_first, last_write_wins, hash_split, oversample_counts, near_leaks, event_islands,
    bm25_corpus_topk_each, bm25_pair_coverage_each, cosine_topk_each, hybrid_blend_rank_each,
    extract_contacts_all,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f.__name__: f for f in _QUERIES}, **more.queries(), **profiles.queries(), **shapes.queries()}


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda t: t NOT IN ({_STOP}))"
_PAIR = f"""
q AS (SELECT DISTINCT unnest({_TOK}) AS t FROM benchmark WHERE item_id = {QUERY_ITEM}),
d AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS n FROM d JOIN q USING (t) GROUP BY ALL)"""
_PAIR_EACH = f"""
i AS (SELECT item_id, list_distinct({_TOK}) AS ts FROM benchmark WHERE item_id % {EACH} = 0),
q AS (SELECT item_id, unnest(ts) AS t FROM i),
d AS (SELECT doc_id, unnest({_TOK}) AS t FROM documents),
tf AS (SELECT item_id, doc_id, t, count(*) AS n FROM d JOIN q USING (t) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(n * 2.5 / (n + 1.5)) AS s FROM tf GROUP BY ALL),
p AS (SELECT item_id, doc_id, text, round(least(1.0, coalesce(s / len(ts), 0.0)), 4) AS x FROM documents CROSS JOIN i LEFT JOIN s USING (item_id, doc_id))"""
_CAND = """
o AS (SELECT o_custkey, count(*) AS n, sum((o_orderpriority = '1-URGENT')::INT) AS urgent, sum((o_orderstatus = 'F')::INT) AS done FROM orders GROUP BY 1),
c AS (SELECT c_custkey, coalesce(n, 0)::INT AS n, coalesce(urgent, 0)::INT AS urgent, coalesce(done, 0)::INT AS done FROM customer LEFT JOIN o ON c_custkey = o_custkey),
s AS (SELECT c_custkey,
  CASE WHEN n * 4 / 12.0 <= 0 THEN 0 WHEN n * 4 / 12.0 < 0.5 THEN 2 WHEN n * 4 / 12.0 < 1 THEN 5 WHEN n * 4 / 12.0 < 2 THEN 9 WHEN n * 4 / 12.0 < 4 THEN 14 WHEN n * 4 / 12.0 < 6 THEN 18 WHEN n * 4 / 12.0 < 8 THEN 22 ELSE 25 END AS experience,
  least(least(done * 8, 20) + least(urgent, 5), 20)::INT AS projects, round_even(least(n / 10.0::DOUBLE, 1.0) * 20, 0)::INT AS skills,
  least(urgent * 2, 10)::INT AS certifications, CASE WHEN done >= 3 THEN 5 WHEN done = 2 THEN 4 WHEN done = 1 THEN 2 ELSE 0 END AS languages, least(urgent * 2, 5)::INT AS leadership FROM c),
r AS (SELECT *, round_even((experience / 25.0::DOUBLE * 0.25 + projects / 20.0::DOUBLE * 0.2 + skills / 20.0::DOUBLE * 0.2 + certifications / 10.0::DOUBLE * 0.1 + languages / 5.0::DOUBLE * 0.05 + leadership / 5.0::DOUBLE * 0.05) / 0.85 * 100, 0)::INT AS total_score FROM s),
l AS (SELECT *, CASE WHEN total_score >= 72 THEN 'Strong' WHEN total_score >= 50 THEN 'Average' ELSE 'Weak' END AS label, total_score BETWEEN 45 AND 51 OR total_score BETWEEN 68 AND 74 AS borderline FROM r)"""
_JUDGED = "j AS (SELECT * FROM labels JOIN documents USING (doc_id))"


def _sql_replace(column: str) -> str:
    out = f"coalesce({column}, '')"
    for a, b in text.ARTIFACTS:
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    for pattern, new in [(text.CONTROLS, ""), (text.DRAWING, ""), *((p, "") for p in text.PAGE_MARKS), (text.BULLET, "- "), (r"[ \t]+", " "), (r"(?m) +$", ""), (r"\n{3,}", "\n\n")]:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), new)
    return f"trim({out}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


_MARKUP = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ANY = "list_sort(list_filter(['ering', 'thing', 'tion'], lambda x: list_contains(w, x)))"


def _macro_sql() -> str:
    bare = lambda p: p.replace("(?i)", "")
    headers = " + ".join(rf"regexp_matches(lower(t), '\b{h}\b')::BIGINT" for h in text.MACRO_HEADERS)
    ranges = " + ".join(f"len(regexp_extract_all(t, '(?i){bare(p)}'))" for p in text.MACRO_RANGES)
    groups = "len(regexp_extract_all(x, '[aeiouy]+'))"
    syllables = f"list_transform(list_transform(w, lambda x: trim(lower(x), chr(39))), lambda x: CASE WHEN x = '' THEN 0 WHEN ends_with(x, 'e') AND {groups} > 1 THEN {groups} - 1 ELSE greatest(1, {groups}) END)"
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, trim(coalesce(text, ''), {_BLANKS}) AS b FROM documents),
c AS (SELECT doc_id, t, regexp_extract_all(t, '[a-zA-Z'']+') AS w, len(list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) != '')) AS line_count,
 greatest(1, len(list_filter(regexp_split_to_array(b, '[.!?]\s+|[.!?]$'), lambda x: length(trim(x, {_BLANKS})) > 2)))::BIGINT AS sentence_count FROM t),
d AS (SELECT *, len(w) AS n, coalesce(list_sum({syllables}), 0) AS s FROM c)
SELECT doc_id, n AS word_count, line_count, sentence_count, round_even(n / sentence_count, 2) AS mean_sentence_len, ({ranges})::BIGINT AS date_range_count,
 greatest({headers}, regexp_matches(lower(t), '{text.MACRO_HISTORY}')::BIGINT) AS section_header_count,
 CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(206.835::DOUBLE - 1.015::DOUBLE * n / sentence_count - 84.6::DOUBLE * s / n, 2))) END AS flesch_reading_ease,
 CASE WHEN n > 0 THEN round_even(length(array_to_string(w, '')) / n, 3) ELSE 0.0::DOUBLE END AS avg_word_len, regexp_matches(t, '@|\+?\d[\d\s.-]{{6,}}')::INT AS has_contact FROM d"""


def oracle_sql() -> dict[str, str]:
    return {
        **more.oracle_sql(),
        **profiles.oracle_sql(),
        **shapes.oracle_sql(),
        "bm25_corpus_topk": f"""WITH {_PAIR},
len AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
st AS (SELECT count(*) AS docs, greatest(avg(dl), 1.0) AS avgdl FROM len), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (SELECT doc_id, round(coalesce(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0.0), 4) AS score
 FROM len CROSS JOIN st LEFT JOIN tf USING (doc_id) LEFT JOIN df USING (t) GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 20""",
        "bm25_pair_coverage": f"WITH {_PAIR}, s AS (SELECT doc_id, sum(n * 2.5 / (n + 1.5)) / (SELECT count(*) FROM q) AS s FROM tf GROUP BY 1) SELECT doc_id, round(least(1.0, coalesce(s, 0.0)), 4) AS score FROM documents LEFT JOIN s USING (doc_id)",
        "clean_documents": f"SELECT doc_id, md5({_sql_replace('text')}) AS clean_md5, length({_sql_replace('text')}) AS clean_chars FROM documents",
        "clean_pages_html": f"SELECT page_id, md5({_MARKUP}) AS clean_md5, length({_MARKUP}) AS clean_chars FROM pages",
        "length_filter": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 100",
        "exact_dedupe": "SELECT sha256(coalesce(text, '')) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "priority_dedupe": "WITH u AS (SELECT 0 AS p, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, conv_id, text FROM conversations), h AS (SELECT sha1(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS text_hash, p, id FROM u) SELECT text_hash, p, id FROM h QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY p, id) = 1",
        "gate_reasons": "SELECT CASE WHEN length(coalesce(text, '')) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
        "rubric_scores": f"WITH {_CAND} SELECT c_custkey, experience, projects, skills, certifications, languages, leadership, total_score, label, borderline FROM l",
        "label_distribution": f"WITH {_CAND} SELECT label, count(*) AS n, round(avg(total_score), 4) AS mean_score, round(stddev_samp(total_score), 4) AS std_score FROM l GROUP BY 1",
        "weakest_sections": f"WITH {_CAND}, u AS (SELECT c_custkey, unnest([{{'s': experience / 25.0::DOUBLE, 'o': 0, 'n': 'experience'}}, {{'s': projects / 20.0::DOUBLE, 'o': 1, 'n': 'projects'}}, {{'s': skills / 20.0::DOUBLE, 'o': 2, 'n': 'skills'}}, {{'s': certifications / 10.0::DOUBLE, 'o': 3, 'n': 'certifications'}}, {{'s': languages / 5.0::DOUBLE, 'o': 4, 'n': 'languages'}}, {{'s': leadership / 5.0::DOUBLE, 'o': 5, 'n': 'leadership'}}]) AS x FROM s), k AS (SELECT c_custkey, x.n AS name, row_number() OVER (PARTITION BY c_custkey ORDER BY x.s, x.o) AS i FROM u WHERE x.s < 0.6), a AS (SELECT c_custkey, string_agg(name, ',' ORDER BY i) AS weakest FROM k WHERE i <= 3 GROUP BY 1) SELECT c_custkey, coalesce(weakest, '') AS weakest FROM c LEFT JOIN a USING (c_custkey)",
        "score_histogram": f"WITH {_CAND} SELECT least(floor(total_score / 5.0), 19)::BIGINT AS bin, count(*) AS n FROM l GROUP BY 1",
        "cosine_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(greatest(0.0, least(1.0, list_inner_product(embedding::DOUBLE[], q))), 4) AS score FROM embeddings, q) SELECT row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20",
        "hybrid_blend_rank": f"WITH {_PAIR}, s AS (SELECT doc_id, sum(n * 2.5 / (n + 1.5)) / (SELECT count(*) FROM q) AS s FROM tf GROUP BY 1), p AS (SELECT doc_id, round(least(1.0, coalesce(s, 0.0)), 4) AS x, least(100, floor(length(text) / 50.0)) AS rubric FROM documents LEFT JOIN s USING (doc_id)), b AS (SELECT doc_id, round(x * 0.5 + x * 0.3 + rubric / 100.0::DOUBLE * 0.2, 4) AS score FROM p) SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20",
        "skill_search_all": f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, array_to_string({_ANY}, ',') AS matched FROM t WHERE len({_ANY}) = 3",
        "skill_search_any": f"WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, array_to_string({_ANY}, ',') AS matched, array_to_string(list_filter(['ering', 'thing', 'tion'], lambda x: NOT list_contains(w, x)), ',') AS unmatched FROM t WHERE len({_ANY}) > 0",
        "extract_contacts": "SELECT * FROM (SELECT doc_id, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.\\w{2,}') AS email, regexp_extract(text, '(?:\\+?\\d{1,3}[-.\\s]?)?(?:\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}|\\d{5}[-.\\s]?\\d{5})') AS phone, regexp_extract(text, '(?i)linkedin\\.com/in/[\\w-]+') AS linkedin FROM documents) WHERE email != '' OR linkedin != ''",
        "extract_contacts_all": "SELECT doc_id, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.\\w{2,}') AS email, regexp_extract(text, '(?:\\+?\\d{1,3}[-.\\s]?)?(?:\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}|\\d{5}[-.\\s]?\\d{5})') AS phone, regexp_extract(text, '(?i)linkedin\\.com/in/[\\w-]+') AS linkedin FROM documents",
        "confusion_metrics": f"WITH {_JUDGED}, x AS (SELECT quality AS t, (n_chars >= 1000)::INT AS g FROM j), k AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT g FROM x) SELECT class, round(coalesce(sum((t = class AND g = class)::INT) / nullif(sum((g = class)::INT), 0), 0.0), 6) AS precision, round(coalesce(sum((t = class AND g = class)::INT) / nullif(sum((t = class)::INT), 0), 0.0), 6) AS recall, round(2 * sum((t = class AND g = class)::INT) / (sum((t = class)::INT) + sum((g = class)::INT)), 6) AS f1, sum((t = class)::INT)::BIGINT AS support FROM k, x GROUP BY class",
        "spearman_ties": f"WITH {_JUDGED}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS b FROM j) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r",
        "ndcg_at_10": f"WITH {_JUDGED}, r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS i FROM j), s AS (SELECT source, sum(CASE WHEN r <= 10 THEN quality / log2(r + 1) END) AS dcg, sum(CASE WHEN i <= 10 THEN quality / log2(i + 1) END) AS idcg FROM r GROUP BY 1) SELECT source, round(dcg / idcg, 6) AS ndcg FROM s WHERE idcg > 0",
        "blend_grid_search": f"WITH {_JUDGED}, x AS (SELECT n_chars / 1000.0::DOUBLE AS a, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS b, quality::DOUBLE AS y FROM j), g AS (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS weight) SELECT weight, round(corr(a * weight + b * (1 - weight), y), 6) AS rho FROM x, g GROUP BY weight",
        "near_leaks": "WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x != '') AS w FROM documents), s AS (SELECT id, list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w), p AS (SELECT a.id AS a_id, b.id AS b_id, a.g AS x, b.g AS y FROM s a JOIN s b ON b.id % 50 = 0 AND a.id != b.id AND len(a.g) > 0 AND len(b.g) > 0 AND least(len(a.g), len(b.g)) * 100 >= greatest(len(a.g), len(b.g)) * 85), c AS (SELECT a_id, b_id, len(list_intersect(x, y)) AS c, len(x) + len(y) AS n FROM p) SELECT a_id, b_id FROM c WHERE c * 100 >= (n - c) * 85",
        "text_macro_features": _macro_sql(),
        "population_stats": "WITH u AS (SELECT source, 'text' AS field, trim(text) AS v FROM documents UNION ALL SELECT source, 'lang', trim(lang) FROM documents) SELECT source, field, sum(coalesce(v != '', false)::INT)::BIGINT AS filled, round(avg(coalesce(v != '', false)::INT) * 100, 4) AS percent, round(avg(CASE WHEN v != '' THEN length(v) END), 4) AS mean_length FROM u GROUP BY 1, 2",
        "pivot_first": "SELECT user_id, min(event_id) FILTER (event_type = 'click') AS click, min(event_id) FILTER (event_type = 'view') AS view, min(event_id) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1",
        "last_write_wins": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1",
        "hash_split": "WITH h AS (SELECT lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 AS k FROM documents) SELECT CASE WHEN k < 75 THEN 'test' WHEN k < 150 THEN 'val' WHEN k < 1000 THEN 'train' END AS split, lang, count(*) AS n FROM h GROUP BY 1, 2",
        "oversample_counts": "SELECT lang, (count(*) * CASE lang WHEN 'es' THEN 6 WHEN 'de' THEN 3 ELSE 1 END)::BIGINT AS n FROM documents GROUP BY lang",
        "bm25_corpus_topk_each": f"""WITH {_PAIR_EACH},
len AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
st AS (SELECT count(*) AS docs, greatest(avg(dl), 1.0) AS avgdl FROM len), df AS (SELECT item_id, t, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(coalesce(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0.0), 4) AS score
 FROM len CROSS JOIN st CROSS JOIN i LEFT JOIN tf USING (item_id, doc_id) LEFT JOIN df USING (item_id, t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sc QUALIFY rank <= 20""",
        "bm25_pair_coverage_each": f"WITH {_PAIR_EACH} SELECT item_id, doc_id, x AS score FROM p",
        "cosine_topk_each": f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {EACH} = 0), s AS (SELECT query_id, vec_id, round(greatest(0.0, least(1.0, list_inner_product(embedding::DOUBLE[], q))), 4) AS score FROM embeddings, q) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20",
        "hybrid_blend_rank_each": f"WITH {_PAIR_EACH}, b AS (SELECT item_id, doc_id, round(x * 0.5 + x * 0.3 + least(100, floor(length(text) / 50.0)) / 100.0::DOUBLE * 0.2, 4) AS score FROM p) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM b QUALIFY rank <= 20",
        "event_islands": "WITH a AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM b GROUP BY user_id, run, event_type",
    }
