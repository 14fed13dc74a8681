"""Streams of uploads: each once within a watermark, and the last write of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys did not come before, within the watermark; state is dropped behind it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def last_write(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """The row of greatest time for each key; run with output mode update or complete."""
    rest = [c for c in stream.columns if c not in (key, ts)]
    return stream.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r")).select(key, "r.*")
