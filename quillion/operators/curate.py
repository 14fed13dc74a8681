"""Duplicates, splits, sampling and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_key

#: Cells that grams are counted in: so many a held-out row, between two powers of two; a bucket of them is filled at once.
CELLS_PER_ROW = 1024
LEAST_CELLS, MOST_CELLS = 16, 23
BUCKET = 4096


def exact_dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text its least id and how many copies there are; only hashes are shuffled."""
    return docs.groupBy(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def priority_dedupe(rows: DataFrame, priority: str, id_col: str, text_col: str = "text") -> DataFrame:
    """Of texts that are equal but for case and white space, the one of least (priority, id)."""
    return rows.groupBy(text_key(F.col(text_col)).alias("text_hash")).agg(F.min(F.struct(F.col(priority), F.col(id_col))).alias("k")).select("text_hash", "k.*")


def gate_reasons(docs: DataFrame, text_col: str = "text", least: int = 100, label_col: str | None = None, labels: tuple = ()) -> DataFrame:
    """How many rows each quality gate stops (the first that applies), and how many pass."""
    length = F.length(F.coalesce(text_col, F.lit("")))
    reason = F.when(length == 0, "empty").when(length < least, "short")
    if label_col:
        reason = reason.when(~F.trim(label_col).isin(*labels), "label")
    return docs.groupBy(reason.otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


def hash_split(rows: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """A reproducible split by the hash of a key; equal keys share a side.  ``shares`` add up to 1000."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 1000
    out, low = F, 0  # F.when first, then Column.when
    for name, share in shares.items():
        low += share
        out = out.when(at < low, name)
    return rows.withColumn("split", out)


def oversample(rows: DataFrame, label: str, reps: dict[str, int]) -> DataFrame:
    """Rows repeated by their label's factor; ``copy`` counts from 1."""
    n = F.lit(1)
    for value, times in reps.items():
        n = F.when(F.col(label) == value, times).otherwise(n)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def _levels(rows: DataFrame, cells: int) -> DataFrame:
    """One row: for each cell from 0 how many rows (column ``cell``) fall into it, as a level of 0 to 124; 0 is none.

    Cells are filled in buckets, so no task holds more than a bucket before the bytes are put together.
    """
    level = F.least(F.lit(124), F.ceil(F.log2(F.count("*") + 1) * 4)).cast("int")
    found = rows.groupBy("cell").agg(level.alias("level"))
    found = found.select((F.col("cell") / BUCKET).cast("int").alias("k"), (F.col("cell") % BUCKET * 128 + F.col("level")).cast("int").alias("v"))
    every = rows.sparkSession.range(cells // BUCKET).select(F.col("id").cast("int").alias("k"), F.lit(None).cast("int").alias("v"))
    found = found.union(every).groupBy("k").agg(F.collect_list("v").alias("v"))
    none = F.array_except(F.sequence(F.lit(0), F.lit(BUCKET - 1)), F.transform("v", lambda v: F.shiftright(v, 7)))
    filled = F.sort_array(F.concat("v", F.transform(none, lambda c: F.shiftleft(c, 7))))
    found = found.select("k", F.transform(filled, lambda v: v.bitwiseAND(127).cast("tinyint")).alias("v"))
    return found.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])).alias("levels"))


def near_leaks(pool: DataFrame, held: DataFrame, percent: int = 85, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pool rows whose words and word pairs reach the Jaccard similarity with some held-out row.

    A prefix join: a pair can only reach the threshold if its prefixes meet, so only prefixes
    are exploded and joined.  Grams are ordered by how many held-out rows have one of their
    cell, so prefixes hold what is rare there; a gram whose cell no held-out row has meets
    nothing and is not shuffled.  Whole sets are made again, and shuffled, for the rows of
    pairs that met only: one row for each different set, and one comparison for each two.
    Cells grow with the held-out rows within bounds; they change the order and no result.
    The held-out side is a query set against all rows of the pool; rows with a null id have
    no leaks.
    """
    rows = held.count()
    cells = 1 << min(MOST_CELLS, max(LEAST_CELLS, (rows * CELLS_PER_ROW).bit_length()))
    cell = lambda h: h.bitwiseAND(F.lit(cells - 1).cast("bigint"))

    def grams(df: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("w"))
        pairs = F.transform("w", lambda w, i: F.when(i > 0, F.xxhash64(F.get("w", i - 1), w)))
        both = F.concat(F.transform("w", lambda w: F.xxhash64(w)), F.filter(pairs, lambda x: x.isNotNull()))
        return rows.select("id", F.array_distinct(both).alias("g"))

    def ordered(df: DataFrame) -> DataFrame:
        """Id, set, its keys (level, then hash) in order, and a digest of them that stands for the set."""
        key = lambda t, h: F.shiftleft(F.get(t, cell(h).cast("int")).cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
        # The row number keeps later filters from being moved below, where they would build the sets anew.
        df = grams(df).withColumn("r", F.monotonically_increasing_id()).where("r >= 0")
        # No lambda may hold a subquery, so the levels are bound before it, in an array with the set; the plan has them in one
        # step as long as the levels have no row number, or all of them would be copied into each row.
        df = df.select("id", "g", levels.scalar().alias("t"))
        keys = F.get(F.transform(F.array(F.struct("g", "t")), lambda s: F.transform(s["g"], lambda h: key(s["t"], h))), F.lit(0))
        df = df.select("id", "g", F.sort_array(keys).alias("k"))
        return df.select("id", "g", "k", F.struct(F.xxhash64(F.lit(1), "k").alias("x"), F.xxhash64(F.lit(2), "k").alias("y")).alias("node"))

    def prefixes(df: DataFrame) -> DataFrame:
        n = F.size("g")  # of the keys it could be null, and a test for that would be moved below and order every set twice
        return ordered(df).select("id", "node", n.alias("n"), F.slice("k", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int")).alias("p"))

    def exploded(df: DataFrame, tag: str, *kept: str) -> DataFrame:
        # No plain explode: its test for empty arrays would be moved below and order every set twice.
        df = df.select(*kept, F.col("node").alias(f"{tag}_node"), F.col("n").alias(f"{tag}_n"), F.posexplode_outer("p").alias(f"{tag}_pos", "h"))
        return df.where(F.col("h") >= 1 << 56)

    levels = _levels(grams(held).select(F.explode_outer("g").alias("h")).where("h IS NOT NULL").select(cell(F.col("h")).alias("cell")), cells)
    a = exploded(prefixes(pool).withColumnRenamed("id", "a_id"), "a", "a_id")
    b = exploded(prefixes(held).groupBy("node").agg(F.first("n").alias("n"), F.first("p").alias("p")), "b")
    fit = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    # At the first common gram of two sets that reach the similarity, enough of both is left.
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    fit = fit & (rest * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)
    met = a.join(b, "h").where(fit & ((F.col("a_node") != F.col("b_node")) | (F.col("a_pos") == 0)))
    # Rows of equal id and set meet a gram as often as there are of them.
    met = met.groupBy("h", "a_id", "a_node", "b_node").agg(F.count("*").cast("int").alias("copies"))
    # The test of copies and, below, the id in a join keep this exchange the same for all that reads it, or the pool would be read for each.
    met = met.groupBy("a_id", "a_node", "b_node").agg(F.max("copies").alias("copies")).where("copies > 0")

    two = met.groupBy("a_node", "b_node").agg(F.min("a_id").alias("a_id"))
    wanted = _levels(two.select(cell(F.xxhash64("a_id")).alias("cell")), cells).scalar()
    some = pool.where(F.get(wanted, cell(F.xxhash64(id_col)).cast("int")) > 0)
    first = ordered(some).groupBy(F.col("id").alias("a_id"), F.col("node").alias("a_node")).agg(F.first("g").alias("a_g"))
    second = ordered(held).groupBy(F.col("node").alias("b_node")).agg(F.first("g").alias("b_g"))
    two = two.join(first, ["a_id", "a_node"]).join(second, "b_node")
    common = F.size(F.array_intersect("a_g", "b_g"))
    two = two.where(common * (100 + percent) >= (F.size("a_g") + F.size("b_g")) * percent).select("a_node", "b_node")
    names = ordered(held).select(F.col("id").alias("b_id"), F.col("node").alias("b_node"))
    met = met.select("b_node", "a_node", F.explode(F.array_repeat("a_id", F.col("copies"))).alias("a_id"))
    return met.join(two, ["a_node", "b_node"]).join(names, "b_node").select("a_id", "b_id")


def drop_leaks(pool: DataFrame, held: DataFrame, percent: int = 85, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The pool without its rows that are near a held-out row; rows with a null id stay."""
    found = near_leaks(pool, held, percent, id_col, text_col).select(F.col("a_id").alias("_gone")).distinct()
    return pool.join(found, F.col(id_col) == F.col("_gone"), "left_anti")


def upsert(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key (by time, then by all other columns): last write wins."""
    rest = [c for c in rows.columns if c not in (key, ts)]
    return rows.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r")).select(key, "r.*")


def islands(rows: DataFrame, group: str, order: str, kind: str, outside: str = "O") -> DataFrame:
    """Runs of equal kinds in order: group, kind, first and last position, size."""
    w = W.partitionBy(group).orderBy(order)
    new = (F.lag(kind).over(w).isNull() | (F.lag(kind).over(w) != F.col(kind))).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy(group, "_run", kind).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    return out.where(F.col(kind) != outside).drop("_run")
