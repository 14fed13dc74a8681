"""Queries over adapters, checks of records and further metrics, and the same results in SQL.

Rows of other makers' shapes are made from the customers' keys; their SQL states the truth from the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, validate
from ..sources import adapters

DOMAIN = r"@[\w-]+\.(\w{2,})$"
EMAIL_LOOSE = r"[\w.+-]+@[\w-]+\.\w{2,}"
EMAIL_STRICT = r"[a-z]{3,}\.\d+@[\w-]+\.\w{2,}"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(spark, sf_dir):
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")


def mean_ndcg_at_10(spark, sf_dir):
    return evaluate.mean_ndcg(_judged(spark, sf_dir), "source", "quality", "n_chars", "doc_id")


def best_blend_weight(spark, sf_dir):
    rows = _judged(spark, sf_dir).select((F.col("n_chars") / 1000.0).alias("a"), F.length(F.regexp_replace("text", "[^.]", "")).cast("double").alias("b"), F.col("quality").cast("double").alias("y"))
    return evaluate.best_blend(rows, "a", "b", "y")


def win_medians(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 100).alias("a"), F.round(F.col("l_tax") * 100).alias("b"))
    return evaluate.wins(rows, "a", "b")


def span_scores_by_type(spark, sf_dir):
    """Addresses by their last label: those of a strict pattern against those of a loose one."""
    docs = _t(spark, sf_dir, "documents")

    def found(pattern: str) -> DataFrame:
        each = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("text"))
        return each.withColumn("type", F.regexp_extract("text", DOMAIN, 1))

    return evaluate.span_scores_by_type(found(EMAIL_LOOSE), found(EMAIL_STRICT))


def run_rates(spark, sf_dir):
    """Each event type as a run: rows, failures (values below 1), seconds."""
    rows = _t(spark, sf_dir, "events").select("event_type", "ts", F.when(F.col("value") < 1, "low").alias("error"))
    return evaluate.rates(rows, "event_type", "ts", "ts", "error")


def _keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))


def record_errors(spark, sf_dir):
    """Records that are wrong by key: every third in a name, every fifth in a role, every seventh no JSON."""
    key = F.col("key").cast("string")
    name = F.when(F.col("key") % 3 == 0, key).otherwise(F.concat(F.lit('"n'), key, F.lit('"')))
    months = F.when(F.col("key") % 5 == 0, F.lit('"soon"')).otherwise(key)
    made = F.concat(F.lit('{"name": '), name, F.lit(', "skills": ["a"], "experience": [{"end": null}, {"duration_months": '), months, F.lit("}]"), F.when(F.col("key") % 7 == 0, "").otherwise("}"))
    return _keys(spark, sf_dir).select("key", F.array_join(validate.errors(made), ",").alias("errors"))


def rebuilt_texts(spark, sf_dir):
    """Texts of structured rows; every fourth has no roles, every third no prizes."""
    key = F.col("key").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = _keys(spark, sf_dir).select(
        "key", say('{"name": "P', key, '", "email": "nan"}').alias("personal_info"),
        F.when(F.col("key") % 4 > 0, say("[{'title': 'T", key, "', 'company': 'C', 'dates': {'start': '2020', 'end': ''}}]")).otherwise("[]").alias("experience"),
        say('[{"degree": {"level": "BSc", "field": "F"}, "institution": {"name": "I', key, '"}}]').alias("education"), F.lit('["go", "sql"]').alias("skills"), F.lit("none").alias("projects"),
        F.when(F.col("key") % 3 > 0, say('["won ', key, '"]')).alias("achievements"),
    )
    return adapters.rebuild(rows).select("key", "text")


def adapted_sections(spark, sf_dir):
    """Rows with another source's keys: what the education section says then."""
    key = F.col("key").cast("string")
    school = F.concat(F.lit('[{"university": "U'), key, F.lit('", "end_date": "'), key, F.lit('"}]'))
    rows = _keys(spark, sf_dir).select("key", F.when(F.col("key") % 2 == 0, F.concat(F.lit("N"), key)).alias("candidate_name"), school.alias("education"), F.lit("[]").alias("experience"))
    found = F.from_json(F.col("sections")["education"], "array<map<string,string>>")[0]
    return adapters.netsol(rows).select("key", F.size("sections").cast("bigint").alias("n"), F.get_json_object(found["institution"], "$.name").alias("school"), F.get_json_object(found["dates"], "$.end").alias("end"))


_QUERIES = (mean_ndcg_at_10, best_blend_weight, win_medians, span_scores_by_type, run_rates, record_errors, rebuilt_texts, adapted_sections)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    k = "c_custkey"
    judged = "j AS (SELECT * FROM labels JOIN documents USING (doc_id))"
    spans = lambda p: f"SELECT DISTINCT doc_id, t, regexp_extract(t, '{DOMAIN}', 1) AS type FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS t FROM documents)"
    share = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0.0), 6)"
    return {
        "mean_ndcg_at_10": f"""WITH {judged}, r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS i FROM j),
s AS (SELECT source, coalesce(sum(quality / log2(r + 1)) FILTER (r <= 10), 0) AS d, sum(quality / log2(i + 1)) FILTER (i <= 10) AS i FROM r GROUP BY 1)
SELECT round(avg(round(d / i, 6)), 6) AS mean_ndcg, count(*) AS groups FROM s WHERE i > 0""",
        "best_blend_weight": f"""WITH {judged}, x AS (SELECT n_chars / 1000.0::DOUBLE AS a, length(regexp_replace(text, '[^.]', '', 'g'))::DOUBLE AS b, quality::DOUBLE AS y FROM j), g AS (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS weight)
SELECT weight, round(corr(a * weight + b * (1 - weight), y), 6) AS rho FROM g, x GROUP BY 1 ORDER BY rho DESC, weight LIMIT 1""",
        "win_medians": """WITH x AS (SELECT round(l_discount * 100) AS a, round(l_tax * 100) AS b FROM lineitem)
SELECT sum((a > b)::INT)::BIGINT AS a_wins, sum((a < b)::INT)::BIGINT AS b_wins, sum((a = b)::INT)::BIGINT AS ties, round(avg(a), 4) AS a_mean, round(avg(b), 4) AS b_mean, round(median(a), 4) AS a_median, round(median(b), 4) AS b_median FROM x""",
        "span_scores_by_type": f"""WITH g AS ({spans(EMAIL_LOOSE)}), f AS ({spans(EMAIL_STRICT)}),
b AS (SELECT type, count(*) FILTER (g) AS gold, count(*) FILTER (f) AS found, count(*) FILTER (g AND f) AS ok FROM (SELECT type, t, doc_id, bool_or(s = 1) AS g, bool_or(s = 2) AS f FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY ALL) GROUP BY 1)
SELECT type, {share('ok', 'found')} AS precision, {share('ok', 'gold')} AS recall, {share('2 * ok', '(gold + found)')} AS f1, gold, found FROM b""",
        "run_rates": """WITH r AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 1) AS failed, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY 1)
SELECT *, round(n / nullif(seconds, 0), 3) AS rows_a_second FROM r""",
        "record_errors": f"SELECT {k} AS key, CASE WHEN {k} % 7 = 0 THEN 'invalid JSON' ELSE concat_ws(',', CASE WHEN {k} % 3 = 0 THEN 'name' END, CASE WHEN {k} % 5 = 0 THEN 'experience.1.duration_months' END) END AS errors FROM customer",
        "rebuilt_texts": f"""SELECT {k} AS key, concat_ws(chr(10), 'P' || {k}, CASE WHEN {k} % 4 > 0 THEN 'EXPERIENCE' || chr(10) || 'T' || {k} || ' at C | 2020 - ' END, 'EDUCATION', 'BSc F at I' || {k}, 'SKILLS', 'go, sql',
 CASE WHEN {k} % 3 > 0 THEN 'ACHIEVEMENTS' || chr(10) || 'won ' || {k} END) AS text FROM customer""",
        "adapted_sections": f"SELECT {k} AS key, CASE WHEN {k} % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, 'U' || {k} AS school, {k}::VARCHAR AS \"end\" FROM customer",
    }
