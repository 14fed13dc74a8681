"""The corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import byte_bpe, decontaminate, ngram_join, pii, quality_rules
from quillion.llm.common import discard, fresh, materialize, read_scratch, rows_at_most, scratch, scratch_path, table

#: Keys of rows to drop are broadcast up to this many (16 bytes each).
BROADCAST_KEYS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much text.

    Null and empty texts fail; repeated rows and ids are judged row by row; columns stay.
    """
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays: that with the least id.

    Shingles of five words, similarity 0.8 or more.  Rows are told apart by a digest of all
    their columns and not by their ids: unlinked rows that share an id stay, linked rows
    without an id are dropped to one, and so are equal rows.  Texts without words stay.
    """
    key = fresh(docs.columns, "_key")
    whole = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    keyed = docs.withColumn(key, F.unhex(F.md5(whole.cast("binary"))))
    found = materialize(ngram_join.link_components(keyed, n=5, percent=80, key_col=key), "components")
    drop = found.where(F.col("first_key").isNotNull() & (F.col(key) != F.col("first_key"))).select(key).distinct()
    if rows_at_most(drop, BROADCAST_KEYS):
        drop = F.broadcast(drop)
    kept = keyed.join(drop, key, "left_anti")
    equal = found.where(F.col(key) == F.col("first_key")).groupBy(key).count().where("count > 1").select(key)
    if not equal.isEmpty():
        one = kept.join(equal, key, "left_semi").dropDuplicates([key])
        kept = kept.join(equal, key, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none; columns stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms; ``n_chars`` follows the text.

    Rows and columns stay; a null text stays null, and so does its ``n_chars``.
    """
    rows = pii.pseudonymise_texts(docs, spans=False)
    return rows.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32-bit little-endian), their count, and digests of ids and decoded bytes.

    One row per row; a null text has no ids.
    """
    rows = byte_bpe.round_trip(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("byte-level BPE", tokens),
]

#: Fingerprints, keyed permutations and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again by the next.

    What a stage wrote for itself, and its input, are deleted once its result stands.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        discard(docs)
        docs = read_scratch(spark, path)
    return docs
