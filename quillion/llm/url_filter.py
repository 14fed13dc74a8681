"""URL allow and block rules, in DataFrame functions only.

Each URL is expanded into its host suffixes joined with its path prefixes; the
expressions meet the rules in an equi-join on a short hash prefix; the full digest
confirms a hit; the longest rule wins.  A URL that no rule fits is allowed: block rules
are given, never guessed from the URL's words.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; a rule of the same length and text as another keeps ``block``;
repeated rows are judged each by itself; empty tables give empty results; only the
key column and the URL are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, rows_at_most

#: (verdict, host, path)
DEFAULT_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The verdict on a URL that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hex digits of the short hash prefix that rules and expressions are joined on.
SHORT = 8
#: Rules are broadcast up to this many rows (about 200 bytes each), else shuffled.
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES) -> DataFrame:
    """Rules as rows: verdict, host, path."""
    row = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*row)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All host suffixes joined with the path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substr(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(host != "", pairs)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    ``rules`` has verdict, host and path.  The distinct lengths of the rules' paths
    (at most the longest path) go to the driver to build the prefixes.  After the join,
    all rows of a URL are still in its own partition, so the aggregate sends one row a
    URL; no key is hot, as each row has an id of its own.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    text = F.concat(F.col("host"), F.col("path"))
    ruled = rules.select(
        text.alias("r_rule"), F.col("verdict").alias("r_verdict"), F.length(text).alias("r_length"), F.sha2(text, 256).alias("r_digest")
    ).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    if rows_at_most(rules, BROADCAST_RULES):
        ruled = F.broadcast(ruled)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    rows = rows.withColumn("digest", F.sha2(F.col("expression"), 256))
    met = rows.join(ruled, F.substring("digest", 1, SHORT) == F.col("r_short"), "left")
    confirmed = F.col("digest") == F.col("r_digest")
    best = F.struct(F.col("r_length"), (F.col("r_verdict") == "block").alias("blocks"), F.col("r_rule"), F.col("r_verdict"))
    out = met.groupBy("row", "id", "host", "path").agg(F.max(F.when(confirmed, best)).alias("best"))
    return out.select(
        F.col("id").alias(key), "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
