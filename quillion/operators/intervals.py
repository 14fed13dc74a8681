"""Intervals and windows of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_days(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Days covered by each key's intervals, overlaps counted once, and the number of gaps' islands."""
    before = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    marked = rows.where(F.col(start) <= F.col(end)).withColumn("_reach", F.max(end).over(before))
    marked = marked.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(W.partitionBy(key).orderBy(start, end)))
    islands = runs.groupBy(key, "_run").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    return islands.groupBy(key).agg(F.sum(F.datediff("e", "s")).cast("bigint").alias("days"), F.count("*").alias("islands"))


def token_windows(rows: DataFrame, id_col: str, n_tokens: Column, size: int = 480, overlap: int = 40) -> DataFrame:
    """Overlapping windows of fixed size over a row's tokens: id, window, start and length."""
    step = size - overlap
    last = F.greatest(F.ceil((F.col("_n") - overlap) / step), F.lit(1)) - 1
    at = rows.select(id_col, n_tokens.cast("bigint").alias("_n")).where("_n > 0")
    at = at.select(id_col, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("window"))
    begin = F.col("window") * step
    return at.select(id_col, "window", begin.alias("start"), F.least(F.lit(size), F.col("_n") - begin).cast("bigint").alias("length"))


def band_join(rows: DataFrame, value: str, bands: list[tuple[float, float, str]]) -> DataFrame:
    """Label rows by half-open bands ``[low, high)``; the bands are a parameter, not data."""
    out = F.lit(None).cast("string")
    for low, high, name in bands:
        out = F.when((F.col(value) >= low) & (F.col(value) < high), name).otherwise(out)
    return rows.withColumn("band", out)
