"""A versioned store of records: comparison and export tables, appends that skip what is there, removal, recovery.

A version is a folder that is written whole or not read at all; no version is changed in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str) -> None:
    """Write the store to a new version beside the old ones; two writers never share a folder."""
    at = rows.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    rows.write.parquet(f"{path}/v={at}-{uuid.uuid4().hex[:8]}")


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that were written whole, the newest first; none for a store that is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted((f.getPath().toString() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))), reverse=True)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest version whose files can be read; an empty table of ``schema`` if there is none."""
    for version in versions(spark, path):
        try:
            return spark.read.parquet(version)
        except (PySparkException, Py4JError):  # footers that do not parse: the version before
            continue
    if schema is None:
        raise FileNotFoundError(f"no readable version in {path}, and no schema for an empty one")
    return spark.createDataFrame([], schema)


def count_saved(spark: SparkSession, path: str) -> int:
    """Rows of the newest version, from the files' footers; 0 without one."""
    return load(spark, path).count() if versions(spark, path) else 0


def remove(spark: SparkSession, path: str, gone: DataFrame, key: str) -> None:
    """A new version without the rows whose key is in ``gone``; rows with a null key stay."""
    save(load(spark, path).join(gone.select(key).distinct(), key, "left_anti"), path)


def clear(spark: SparkSession, path: str) -> None:
    """A new version without rows; older ones stay until they are vacuumed."""
    save(load(spark, path).where(F.lit(False)), path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all whole versions but the newest ones."""
    for version in versions(spark, path)[max(keep, 1) :]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(version)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append to a Parquet table the rows whose keys it does not have; of equal keys in ``rows`` one stays."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates(keys)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(path)


def resume(rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], parts: int = 16) -> None:
    """Run ``work`` over parts of the rows by hash of their key and append each; a run that was cut off goes on where it ended.

    ``work`` keeps the key column.  Keys that the table at ``path`` holds are not worked on again.
    """
    for i in range(parts):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        spark = rows.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            part = part.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti").select(*rows.columns)
        work(part).write.mode("append").parquet(path)


def save_batches(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: every batch is appended once, also when it is delivered again."""
    return lambda rows, _batch: append_new(rows, path, keys)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row."""
    rows.write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str, by: str) -> DataFrame:
    """Rows and share of each value of a column, written as one CSV file with a header."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    out = counts.crossJoin(F.broadcast(whole)).select(by, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share")).orderBy(by)
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return out


def _size(field: Column) -> Column:
    return F.greatest(F.size(field), F.lit(0)).cast("bigint")


def comparison(rows: DataFrame, cv_col: str = "cv") -> DataFrame:
    """One row per record with its score and how many entries its parts have, the best first.

    ``rows`` have cv_id, cv, total_score and label; warnings, filename, extractor and timestamp where there are any.
    """
    cv, have = F.col(cv_col), set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    out = rows.select(
        "cv_id", F.coalesce(F.nullif(cv["name"], F.lit("")), F.lit("Unknown")).alias("name"), F.coalesce("total_score", F.lit(0)).alias("score"), F.coalesce("label", F.lit("")).alias("label"),
        *[_size(cv[c]).alias(c) for c in ("skills", "experience", "education", "projects")], F.replace(text("extractor"), F.lit("spaCy + "), F.lit("")).alias("engine"),
        (_size(F.col("warnings")) if "warnings" in have else F.lit(0).cast("bigint")).alias("flagged"), text("filename").alias("filename"), F.substring(text("timestamp"), 1, 10).alias("date"),
    )
    return out.orderBy(F.desc("score"), "cv_id")


def detailed(rows: DataFrame, cv_col: str = "cv") -> DataFrame:
    """One row per record with its parts as delimited texts, the best first; for CSV or JSON."""
    cv, have = F.col(cv_col), set(rows.columns)
    empty = lambda *fs: lambda x: F.concat(*[F.coalesce(x[f], F.lit("")) for f in fs]) != ""
    pair = lambda c, a, b: F.array_join(F.transform(F.filter(cv[c], empty(a, b)), lambda x: F.concat(F.coalesce(x[a], F.lit("")), F.lit(" @ "), F.coalesce(x[b], F.lit("")))), "; ")
    one = lambda c, f: F.array_join(F.filter(F.transform(cv[c], lambda x: x[f]), lambda v: v != ""), "; ")
    fit = F.round(F.coalesce(F.col("final_match_score"), F.lit(0.0)) * 100, 1) if "final_match_score" in have else F.lit(0.0)
    missing = F.coalesce(F.array_join("missing_skills", ", "), F.lit("")) if "missing_skills" in have else F.lit("")
    out = rows.select(
        "cv_id", cv["name"].alias("name"), cv["email"].alias("email"), cv["phone"].alias("phone"), F.coalesce("total_score", F.lit(0)).alias("score"), F.coalesce("label", F.lit("")).alias("label"),
        F.array_join(cv["skills"], ", ").alias("skills"), pair("experience", "title", "company").alias("experience"), pair("education", "degree", "institution").alias("education"),
        one("projects", "name").alias("projects"), one("certifications", "name").alias("certifications"), one("languages", "language").alias("languages"),
        fit.alias("match_percent"), missing.alias("missing_skills"),
    )
    return out.orderBy(F.desc("score"), "cv_id")
