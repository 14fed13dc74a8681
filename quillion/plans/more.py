"""Further queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import entities, evaluate, intervals, models

BANDS = [(float("-inf"), 0.0, "debt"), (0.0, 2500.0, "low"), (2500.0, 7500.0, "mid"), (7500.0, float("inf"), "high")]
STATUS_WEIGHTS = {"F": 0.5, "O": 0.3, "P": 0.2}
EMAIL_LOOSE = r"[\w.+-]+@[\w-]+\.\w{2,}"
EMAIL_STRICT = r"[a-z]{3,}\.\d+@[\w-]+\.\w{2,}"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged_ranges(spark, sf_dir):
    """Days that a customer's orders were under way, from order to shipping."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ships = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"))
    return intervals.merged_days(rows, "o_custkey", "o_orderdate", "shipped")


def token_windows(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return intervals.token_windows(docs, "doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))


def rubric_bands(spark, sf_dir):
    rows = intervals.band_join(_t(spark, sf_dir, "customer"), "c_acctbal", BANDS)
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def band_probabilities(spark, sf_dir):
    score = F.abs("c_acctbal") / 100
    weak, average, strong = scoring.band_probabilities(score)
    return _t(spark, sf_dir, "customer").select("c_custkey", *[F.round(p, 5).alias(n) for p, n in ((weak, "weak"), (average, "average"), (strong, "strong"))])


def weighted_sections(spark, sf_dir):
    """A customer's mean order value by status, weighted over the statuses present."""
    rows = _t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.avg("o_totalprice") / 500000).alias("value"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_WEIGHTS.items() for x in kv]), F.col("o_orderstatus"))
    return rows.groupBy("o_custkey").agg(F.round(F.sum(F.col("value") * weight) / F.sum(weight), 4).alias("score"))


def agreement_rate(spark, sf_dir):
    return _t(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("agreement"))


def mismatch_means(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").where("quality != toxic").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


def span_scores(spark, sf_dir):
    """Addresses found by a strict pattern, against those found by a loose one."""
    docs = _t(spark, sf_dir, "documents")
    found = lambda p: docs.select("doc_id", F.lit("email").alias("type"), F.explode(F.regexp_extract_all("text", F.lit(p), 0)).alias("text"))
    scores = evaluate.span_scores(found(EMAIL_LOOSE), found(EMAIL_STRICT))
    return scores.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def null_counts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}_nulls") for c in ("text", "lang", "source")])


def distinct_values(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"))


def best_by_segment(spark, sf_dir):
    order = F.struct("c_acctbal", -F.col("c_custkey"))
    return _t(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", order).alias("c_custkey"), F.max("c_acctbal").alias("c_acctbal"))


def json_pick(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("k_sum"), F.min(k).alias("k_min"), F.max(k).alias("k_max"))


def chat_messages(spark, sf_dir):
    """One row per conversation: its turns in order, as one text."""
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["text"], F.lit("")))
    return rows.select("conv_id", F.size("m").cast("bigint").alias("turns"), F.md5(F.array_join(F.transform("m", line), "\n")).alias("chat_md5"))


def win_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    win = lambda c: F.sum(c.cast("bigint"))
    return rows.agg(win(F.round("a") > F.round("b")).alias("a_wins"), win(F.round("a") < F.round("b")).alias("b_wins"), win(F.round("a") == F.round("b")).alias("ties"), F.round(F.avg("a"), 4).alias("a_mean"), F.round(F.avg("b"), 4).alias("b_mean"))


def parser_gate(spark, sf_dir):
    """Share of conversations' turns that pass the gate of 50 characters and two words, against 85 %."""
    passed = (F.length("text") >= 50) & (F.size(F.split("text", " ")) >= 2)
    rate = F.avg(F.coalesce(passed, F.lit(False)).cast("int"))
    return _t(spark, sf_dir, "conversations").groupBy("role").agg(F.round(rate, 6).alias("rate"), (rate >= 0.85).alias("passed"))


def join_baseline(spark, sf_dir):
    """Documents with their labels where there are any; unlabelled ones stay."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"))


def unlabelled(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def format_durations(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("months"))
    return orders.select("o_custkey", scoring.format_duration(F.col("months")).alias("duration"))


def quality_model(spark, sf_dir):
    """Each document's probability of good quality, learned from the labelled ones."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return models.apply_quality(models.train_quality(known), docs)


def extract_certifications(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(entities.certifications(F.col("text"))).alias("pos", "c"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("c.name").alias("name_md5"), F.col("c.year").alias("year"))


def extract_languages(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(entities.languages(F.col("text"))).alias("l"))
    return rows.select("doc_id", "l.language", "l.proficiency")


_QUERIES = (
    extract_certifications, extract_languages,
    merged_ranges, token_windows, rubric_bands, band_probabilities, weighted_sections, agreement_rate, mismatch_means, span_scores,
    null_counts, distinct_values, best_by_segment, json_pick, chat_messages, win_summary, parser_gate, join_baseline, unlabelled,
    format_durations, quality_model,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _sql_phi(z: str) -> str:
    t = f"(1 / (1 + {scoring.ERF_P}::DOUBLE * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = "0.0::DOUBLE"
    for a in reversed(scoring.ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"(0.5::DOUBLE * (1 + sign({z}) * (1 - {poly} * exp(-({z}) * ({z}) / 2))))"


def _sql_languages(lines: str, spaces: str) -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    held = lambda words: "CASE " + " ".join(f"WHEN contains(lower(x), '{w}') THEN '{w}'" for w in words) + " END"
    return f"""WITH u AS (SELECT doc_id, unnest({lines}) AS x FROM documents),
p AS (SELECT doc_id, x, trim(regexp_extract(x, '{entities.LANG_PAREN}', 1), {spaces}) AS b, regexp_extract(x, '{entities.LANG_PAREN}', 2) AS bl,
  trim(split_part(x, ',', 1), {spaces}) AS c, trim(substr(x, strpos(x, ',') + 1), {spaces}) AS cl, {held(entities.KNOWN_LANGUAGES)} AS k, {held(entities.LANG_PROFICIENCY)} AS kl
 FROM u WHERE trim(split_part(lower(x), ':', 1), {spaces}) NOT IN ({quoted(entities.TECH_CATEGORY_HEADERS)})),
q AS (SELECT doc_id, CASE WHEN lower(b) IN ({quoted(entities.KNOWN_LANGUAGES)}) THEN {{'l': b, 'p': bl}}
  WHEN contains(x, ',') AND lower(c) IN ({quoted(entities.KNOWN_LANGUAGES)}) THEN {{'l': c, 'p': cl}}
  WHEN k IS NOT NULL THEN {{'l': upper(k[1]) || k[2:], 'p': kl}} END AS r FROM p)
SELECT doc_id, r.l AS language, r.p AS proficiency FROM q WHERE r IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {spaces})), lambda x: x != '')"
    words = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    return {
        "merged_ranges": "WITH s AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1), r AS (SELECT o_custkey, o_orderdate AS s, e FROM orders JOIN s ON o_orderkey = l_orderkey WHERE o_orderdate <= e), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), n AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY o_custkey ORDER BY s, e) AS run FROM m), i AS (SELECT o_custkey, run, min(s) AS s, max(e) AS e FROM n GROUP BY 1, 2) SELECT o_custkey, sum(date_diff('day', s::DATE, e::DATE))::BIGINT AS days, count(*) AS islands FROM i GROUP BY 1",
        "extract_certifications": f"WITH c AS (SELECT doc_id, list_filter({lines}, lambda x: regexp_matches(lower(x), '{'|'.join(entities.CERT_KEYWORDS)}')) AS c FROM documents), u AS (SELECT doc_id, unnest(range(0, len(c))) AS pos, unnest(c) AS name FROM c) SELECT doc_id, pos, md5(name) AS name_md5, nullif(regexp_extract(name, '{entities.YEAR}', 1), '')::INT AS year FROM u",
        "extract_languages": _sql_languages(lines, spaces),
        "token_windows": f"WITH d AS (SELECT doc_id, {words} AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 40) / 440.0), 1)::BIGINT)) AS w FROM d WHERE n > 0) SELECT doc_id, w AS window, w * 440 AS start, least(480, n - w * 440)::BIGINT AS length FROM w".replace("AS window", 'AS "window"'),
        "rubric_bands": "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1",
        "band_probabilities": f"WITH x AS (SELECT c_custkey, abs(c_acctbal) / 100 AS s FROM customer), p AS (SELECT c_custkey, {_sql_phi('((50 - s - 1e-6) / 12)')} AS w, 1 - {_sql_phi('((72 - s - 1e-6) / 12)')} AS g FROM x), q AS (SELECT *, greatest(0.0::DOUBLE, 1 - w - g) AS a FROM p) SELECT c_custkey, round(w / (w + a + g), 5) AS weak, round(a / (w + a + g), 5) AS average, round(g / (w + a + g), 5) AS strong FROM q",
        "weighted_sections": "WITH r AS (SELECT o_custkey, avg(o_totalprice) / 500000 AS v, CASE o_orderstatus WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 0.3::DOUBLE WHEN 'P' THEN 0.2::DOUBLE END AS w FROM orders GROUP BY o_custkey, o_orderstatus) SELECT o_custkey, round(sum(v * w) / sum(w), 4) AS score FROM r GROUP BY 1",
        "agreement_rate": "SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels",
        "mismatch_means": "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) WHERE quality != toxic GROUP BY 1, 2",
        "span_scores": f"WITH g AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{EMAIL_LOOSE}')) AS t FROM documents), f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{EMAIL_STRICT}')) AS t FROM documents), c AS (SELECT (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM g JOIN f USING (doc_id, t)) AS ok) SELECT round(ok / f, 6) AS precision, round(ok / g, 6) AS recall, round(2 * ok / (g + f), 6) AS f1 FROM c",
        "null_counts": "SELECT count(*) AS n, sum((text IS NULL)::INT)::BIGINT AS text_nulls, sum((lang IS NULL)::INT)::BIGINT AS lang_nulls, sum((source IS NULL)::INT)::BIGINT AS source_nulls FROM documents",
        "distinct_values": "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY 1",
        "best_by_segment": "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1",
        "json_pick": "WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS n, sum(k)::BIGINT AS k_sum, min(k) AS k_min, max(k) AS k_max FROM e GROUP BY 1",
        "chat_messages": "SELECT conv_id, count(*) AS turns, md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS chat_md5 FROM conversations GROUP BY 1",
        "win_summary": "WITH r AS (SELECT l_discount * 100 AS a, l_tax * 100 AS b FROM lineitem) SELECT sum((round(a) > round(b))::INT)::BIGINT AS a_wins, sum((round(a) < round(b))::INT)::BIGINT AS b_wins, sum((round(a) = round(b))::INT)::BIGINT AS ties, round(avg(a), 4) AS a_mean, round(avg(b), 4) AS b_mean FROM r",
        "parser_gate": "WITH r AS (SELECT role, coalesce(length(text) >= 50 AND len(string_split(text, ' ')) >= 2, false)::INT AS ok FROM conversations) SELECT role, round(avg(ok), 6) AS rate, avg(ok) >= 0.85 AS passed FROM r GROUP BY 1",
        "join_baseline": "SELECT source, count(*) AS n, count(quality) AS labelled, sum(coalesce(quality, 0))::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
        "unlabelled": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "format_durations": "WITH o AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN m // 12 > 0 AND m % 12 > 0 THEN (m // 12) || 'y ' || (m % 12) || 'm' WHEN m // 12 > 0 THEN (m // 12) || 'y' ELSE (m % 12) || 'm' END AS duration FROM o",
    }
