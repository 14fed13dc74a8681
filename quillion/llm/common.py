"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.  Every helper is a pure function of
the session and its arguments; scratch tables go to the folder that the cluster
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
ASCII_SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables that still stand, and the path of each table that was read back from one.
_STANDING: set[str] = set()
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session (as in tests) gets a temporary one; on a cluster it
    is an error, as each executor would write to its own disk.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillion-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/quillion/{uuid.uuid4().hex}-{tag}"
    _STANDING.add(path)
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, if it stands and the session still lives."""
    if path not in _STANDING:
        return
    _STANDING.discard(path)
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone at exit
        pass


def read_scratch(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table at a scratch path, which :func:`discard` can delete."""
    out = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    _PATHS[out] = path
    return out


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return read_scratch(df.sparkSession, path, df.schema)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            drop_path(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written for this block's own use is deleted when it ends."""
    before = set(_STANDING)
    try:
        yield
    finally:
        for path in _STANDING - before:
            drop_path(spark, path)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no taken name starts like it (without regard to case)."""
    lowered = [c.lower() for c in taken]
    while any(c.startswith(name.lower()) for c in lowered):
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, ASCII_SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else left as it is."""
    return F.translate(text, UPPER, LOWER)


def rows_at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has no more than ``bound`` rows (reads ``bound + 1`` at most)."""
    return df.limit(bound + 1).count() <= bound


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass the batches on; at the end, give freed memory back to the system.

    Spark keeps Python workers for later tasks and stages; what they hold on to would
    count against executors that no longer need it.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
