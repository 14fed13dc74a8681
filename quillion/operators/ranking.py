"""Lexical scores, blends and searches over a pool of texts.

Nulls count as empty texts; ties are broken by id; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Bytes of query texts or vectors that one broadcast holds.
BLOCK_BYTES = 32 << 20


def query_blocks(query: DataFrame, id_col: str, value_col: str, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The query set in blocks of about ``limit`` bytes, so that each can be broadcast; every row is in one block.

    One row above the limit is a block of its own.  Most query sets are a single block.
    """
    size = F.coalesce(F.octet_length(F.col(value_col).cast("string")), F.lit(0)) + 64
    total = query.agg(F.sum(size)).first()[0] or 0
    n = -(-total // limit) or 1
    return [query] if n == 1 else [query.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i) for i in range(n)]


def _queries(query: DataFrame, query_col: str | None) -> DataFrame:
    """Query id and its distinct terms; without an id column, one query is allowed and more are an error."""
    terms = F.array_sort(F.array_distinct(tokens(F.col("text"))))
    if query_col:
        return query.select(F.col(query_col).alias("_q"), terms.alias("terms"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one query, but no query_col"))).otherwise(terms)
    return query.crossJoin(query.agg(F.count("*").alias("_n"))).select(F.lit(0).alias("_q"), one.alias("terms"))


def _hits(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document and query its length and, of the query's terms that it holds, how often each occurs.

    Which terms occur is one pass with a hash set; only those are counted.
    """
    words = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("words"))
    rows = words.crossJoin(F.broadcast(terms))
    held = F.transform(F.array_intersect("terms", "words"), lambda t: F.struct(t.alias("t"), (F.size("words") - F.size(F.array_remove("words", t))).alias("n")))
    return rows.select("_q", id_col, F.size("words").alias("dl"), held.alias("hits"), F.size("terms").alias("wanted"))


def _lead(query_col: str | None) -> list[Column]:
    return [F.col("_q").alias(query_col)] if query_col else []


def _blocks(query: DataFrame, query_col: str | None) -> list[DataFrame]:
    return query_blocks(query, query_col, "text") if query_col else [query]


def bm25_corpus(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str | None = None) -> DataFrame:
    """BM25 score of every document for each query text; documents without a hit get 0.

    ``query`` has a column ``text``, and ``query_col`` where it has more than one row; that
    column then leads the result.  Term counts stay inside each row, so no token is shuffled:
    one aggregate with map-side sums gives document frequencies and lengths, a second pass
    the scores.  Queries go in blocks of a checked size.
    """
    out = [_bm25_block(docs, block, id_col, text_col, query_col) for block in _blocks(query, query_col)]
    return reduce(DataFrame.unionByName, out)


def _bm25_block(docs: DataFrame, query: DataFrame, id_col: str, text_col: str, query_col: str | None) -> DataFrame:
    rows = _hits(docs, _queries(query, query_col), id_col, text_col)
    # The term null stands for the document itself: its count is that of the documents, its sum their length.
    terms = F.concat(F.transform("hits", lambda h: h["t"]), F.array(F.lit(None).cast("string")))
    # No plain explode: its test for empty arrays would be moved below and count every text twice.
    seen = rows.select("_q", "dl", F.explode_outer(terms).alias("t")).groupBy("_q", "t").agg(F.count("*").alias("n"), F.sum("dl").alias("length"))
    pairs = F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "n")))
    seen = seen.groupBy(F.col("_q").alias("_s")).agg(
        F.map_from_entries(pairs).alias("dfs"), F.max(F.when(F.col("t").isNull(), F.col("n"))).alias("docs"), F.max(F.when(F.col("t").isNull(), F.col("length") / F.col("n"))).alias("avgdl")
    )
    rows = rows.join(F.broadcast(seen), F.col("_q").eqNullSafe(F.col("_s")))

    def part(total, h):
        df, n = F.element_at("dfs", h["t"]), h["n"]
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        return total + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))

    return rows.select(*_lead(query_col), id_col, F.round(F.aggregate("hits", F.lit(0.0), part), 4).alias("score"))


def bm25_pair(docs: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str | None = None) -> DataFrame:
    """Coverage of each query's terms by each document: saturated counts over distinct terms, at most 1."""

    def block(part: DataFrame) -> DataFrame:
        rows = _hits(docs, _queries(part, query_col), id_col, text_col)
        total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["n"] * (K1 + 1) / (h["n"] + K1))
        score = F.when(F.col("wanted") == 0, 0.0).otherwise(F.least(F.lit(1.0), total / F.col("wanted")))
        return rows.select(*_lead(query_col), id_col, F.round(score, 4).alias("score"))

    return reduce(DataFrame.unionByName, [block(part) for part in _blocks(query, query_col)])


def top_k(rows: DataFrame, k: int, score_col: str = "score", id_col: str = "doc_id", by: str | None = None) -> DataFrame:
    """The k best rows (of each ``by``) with their rank; each task sends k rows at most (of each)."""
    if by:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score_col), id_col))
        return rows.withColumn("rank", place).where(F.col("rank") <= k).select(by, "rank", *[c for c in rows.columns if c != by])
    best = rows.orderBy(F.desc(score_col), id_col).limit(k)
    one = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(score_col)).alias("s"), F.col(id_col).alias("i"), F.struct(*rows.columns).alias("r")))).alias("a"))
    return one.select(F.posexplode("a").alias("p", "x")).select((F.col("p") + 1).alias("rank"), "x.r.*")


def term_search(docs: DataFrame, wanted: Sequence[str], every: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold all (or any) of the wanted terms, with matched and unmatched ones."""
    terms = F.array(*[F.lit(w) for w in sorted({w.strip().lower() for w in wanted if w.strip()})])
    rows = docs.select(id_col, F.array_sort(F.array_intersect(terms, tokens(F.col(text_col)))).alias("matched"))
    rows = rows.withColumn("unmatched", F.array_sort(F.array_except(terms, "matched")))
    return rows.where((F.size("unmatched") == 0) if every else (F.size("matched") > 0))
