"""Metrics over labelled rows; every one a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fusion


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, truth: str, guess: str, digits: int = 6) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion counts."""
    cells = confusion(rows, truth, guess)
    each = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col("truth") == F.col("guess")).cast("int").alias("ok")), F.struct(F.col("guess").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("ok")))).alias("x"), "n")
    sums = each.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("x.t") * F.col("n")).alias("t"), F.sum(F.col("x.g") * F.col("n")).alias("g"), F.sum(F.col("x.ok") * F.col("n")).alias("ok"))
    p, r = F.col("ok") / F.nullif(F.col("g"), F.lit(0)), F.col("ok") / F.nullif(F.col("t"), F.lit(0))
    f1 = F.coalesce(2 * F.col("ok") / F.nullif(F.col("t") + F.col("g"), F.lit(0)), F.lit(0.0))
    rnd = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return sums.select("class", rnd(p).alias("precision"), rnd(r).alias("recall"), F.round(f1, digits).alias("f1"), F.col("t").alias("support"))


def summary_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, F1 averaged over classes, and F1 weighted by the classes' rows."""
    each = class_metrics(rows, truth, guess, 15)
    n = F.sum("support")
    found = each.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("a"), F.avg("f1").alias("m"), (F.sum(F.col("f1") * F.col("support")) / n).alias("w"), n.alias("n"))
    right = rows.agg(F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"))
    return found.crossJoin(right).select(F.round("accuracy", 6).alias("accuracy"), F.round("m", 6).alias("macro_f1"), F.round("w", 6).alias("weighted_f1"), "n")


def tie_ranks(rows: DataFrame, col: str, name: str, buckets: int = 4096) -> DataFrame:
    """Average rank of each value of a numeric column.

    Ranks come from counts by value.  Values are cut into equal ranges between the least and
    the greatest; running sums are taken inside a range and the ranges' own sums are added, so
    no task sees all values.  The table of ranges has ``buckets`` rows at most.
    """
    counts = rows.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ends = counts.agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    at = F.when((span > 0) & (span < float("inf")), F.floor((F.col("_v").cast("double") - F.col("_lo")) / span * buckets)).otherwise(F.lit(0))
    counts = counts.crossJoin(F.broadcast(ends)).select("_v", "_n", at.alias("_b"))
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_below"))
    upto = F.sum("_n").over(W.partitionBy("_b").orderBy("_v"))
    ranked = counts.withColumn("_in", upto).join(F.broadcast(sums), "_b").select("_v", (F.col("_below") + F.col("_in") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranked, F.col(col) == F.col("_v")).drop("_v")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    rows = tie_ranks(tie_ranks(rows.select(a, b).dropna(), a, "_ra"), b, "_rb")
    return rows.agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.count("*").alias("n"))


def ndcg(rows: DataFrame, group: str, relevance: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """NDCG with linear gain by group; groups without any relevant row are left out.

    Each ranking keeps k rows a group, which every task does before the shuffle, so no group is sorted whole.
    """

    def gain(by: str, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), tie))
        best = rows.select(group, relevance, score, tie).withColumn("_r", place).where(F.col("_r") <= k)
        return best.groupBy(group).agg(F.sum(F.col(relevance) / F.log2(F.col("_r") + 1)).alias(name))

    ideal = gain(relevance, "idcg").where("idcg > 0").withColumnRenamed(group, "_g")
    both = gain(score, "dcg").join(ideal, F.col(group).eqNullSafe(F.col("_g")))
    return both.select(group, F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))


def mean_ndcg(rows: DataFrame, group: str, relevance: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """The mean over groups that have a relevant row, and how many those are."""
    return ndcg(rows, group, relevance, score, tie, k).agg(F.round(F.avg("ndcg"), 6).alias("mean_ndcg"), F.count("*").alias("groups"))


def span_scores(gold: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id", "type", "text")) -> DataFrame:
    """Micro precision, recall and F1 of span sets."""
    g, f = gold.select(*keys).distinct(), found.select(*keys).distinct()
    both = g.withColumn("g", F.lit(1)).join(f.withColumn("f", F.lit(1)), list(keys), "full")
    sums = both.agg(F.sum("g").alias("g"), F.sum("f").alias("f"), F.sum(F.col("g") * F.col("f")).alias("ok"))
    return sums.select((F.col("ok") / F.col("f")).alias("precision"), (F.col("ok") / F.col("g")).alias("recall"), (2 * F.col("ok") / (F.col("g") + F.col("f"))).alias("f1"))


def blend_grid(rows: DataFrame, a: str, b: str, target: str, steps: int = 20) -> DataFrame:
    """For each weight of ``a`` against ``b`` from 0 to 1 the correlation of the blend with a target."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps)))
    grid = rows.select(a, b, target, F.explode(weights).alias("weight"))
    return grid.groupBy("weight").agg(F.round(F.corr(F.col(a) * F.col("weight") + F.col(b) * (1 - F.col("weight")), F.col(target)), 6).alias("rho"))


def best_blend(rows: DataFrame, a: str, b: str, target: str, steps: int = 20) -> DataFrame:
    """The weight whose blend correlates best with a target (the least one of ties); none counts as worst."""
    order = F.struct(F.coalesce(F.col("rho"), F.lit(-2.0)), -F.col("weight"))
    return blend_grid(rows, a, b, target, steps).agg(F.max_by(F.struct("weight", "rho"), order).alias("x")).select("x.*")


def span_scores_by_type(gold: DataFrame, found: DataFrame, type_col: str = "type", keys: tuple[str, ...] = ("doc_id", "type", "text")) -> DataFrame:
    """Precision, recall and F1 of span sets for each type; a share of nothing is 0."""
    g, f = gold.select(*keys).distinct(), found.select(*keys).distinct()
    both = g.withColumn("g", F.lit(1)).join(f.withColumn("f", F.lit(1)), list(keys), "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.groupBy(type_col).agg(n(F.col("g")).alias("gold"), n(F.col("f")).alias("found"), n(F.col("g") * F.col("f")).alias("ok"))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    ok, gold_n, found_n = F.col("ok"), F.col("gold"), F.col("found")
    return sums.select(type_col, share(ok, found_n).alias("precision"), share(ok, gold_n).alias("recall"), share(2 * ok, gold_n + found_n).alias("f1"), "gold", "found")


def wins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How often each of two scores is the higher one, with means and medians of both."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    middle = lambda c: F.round(F.median(c), 4)
    return rows.agg(
        count(F.col(a) > F.col(b)).alias("a_wins"), count(F.col(a) < F.col(b)).alias("b_wins"), count(F.col(a) == F.col(b)).alias("ties"),
        F.round(F.avg(a), 4).alias("a_mean"), F.round(F.avg(b), 4).alias("b_mean"), middle(a).alias("a_median"), middle(b).alias("b_median"),
    )


def grounded_ratio(rows: DataFrame, values: str, text: str, by: str) -> DataFrame:
    """Per group how many of the rows' values stand in their texts, of how many, and the share (1 without any value)."""
    sizes = rows.select(by, F.size(F.coalesce(values, F.array().cast("array<string>"))).alias("n"), F.coalesce(F.size(fusion.grounded(F.col(values), F.col(text))), F.lit(0)).alias("ok"))
    sums = sizes.groupBy(by).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return sums.select(by, "n", F.col("ok").alias("grounded"), F.round(F.coalesce(F.col("ok") / F.nullif("n", F.lit(0)), F.lit(1.0)), 6).alias("ratio"))


def rates(rows: DataFrame, by: str, begun: str, ended: str, error: str) -> DataFrame:
    """Per run its rows, failed rows, seconds from the first begin to the last end, and rows a second."""
    seconds = F.unix_micros(F.max(F.col(ended).cast("timestamp"))) / 1e6 - F.unix_micros(F.min(F.col(begun).cast("timestamp"))) / 1e6
    found = rows.groupBy(by).agg(F.count("*").alias("n"), F.count(error).alias("failed"), F.round(seconds, 3).alias("seconds"))
    return found.withColumn("rows_a_second", F.round(F.col("n") / F.nullif("seconds", F.lit(0.0)), 3))


def population(rows: DataFrame, fields: list[str], by: str) -> DataFrame:
    """How many rows fill each field, and its mean length over filled rows."""
    unpivoted = rows.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("v")) for f in fields])).alias("x"))
    filled = F.coalesce(F.col("x.v") != "", F.lit(False))
    return unpivoted.groupBy(by, F.col("x.field").alias("field")).agg(
        F.sum(filled.cast("bigint")).alias("filled"), F.round(F.avg(filled.cast("double")) * 100, 4).alias("percent"), F.round(F.avg(F.when(filled, F.length("x.v"))), 4).alias("mean_length")
    )
