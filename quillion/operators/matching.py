"""Records against job descriptions: similarity, skills, rubric and lexical coverage in one score.

Jobs are the small side: they are broadcast up to ``BROADCAST_JOBS``, beyond that each
part of them meets all records in turn of a shuffled cross of blocks.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import tokens
from . import ranking
from .skills import extract_skills

#: Jobs are broadcast up to this many (a few kB each).
BROADCAST_JOBS = 20_000
WEIGHTS = {"semantic": 0.5, "skill": 0.3, "rubric": 0.2, "bm25": 0.0}
#: Weights of sections; those without a text are left out and the rest made up to one.
SECTION_WEIGHTS = {"skills": 0.30, "experience": 0.25, "summary": 0.15, "projects": 0.15, "education": 0.10, "achievements": 0.03, "certifications": 0.02}
HASHED = 64


def default_weights(given: str | None = None) -> dict[str, float]:
    """The weights, or four numbers apart by commas (as in CV_RANK_WEIGHTS) made up to one."""
    raw = os.environ.get("CV_RANK_WEIGHTS", "") if given is None else given
    parts = [float(x) for x in raw.split(",")] if raw else []
    return {k: x / sum(parts) for k, x in zip(WEIGHTS, parts)} if len(parts) == 4 and sum(parts) > 0 else dict(WEIGHTS)


def embed(text: Column, cells: int = HASHED) -> Column:
    """A unit vector of hashed word counts, the default where no vectors are given; zero for blank texts."""
    words = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(cells)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.size(F.filter(words, lambda w: w == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def section_score(sections: Column, job: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the similarities of a map of section texts with a job's vector."""
    weights = weights or SECTION_WEIGHTS
    text = {k: F.coalesce(F.try_element_at(sections, F.lit(k)), F.lit("")) for k in weights}
    used = {k: F.when(F.btrim(t) != "", weights[k]).otherwise(0.0) for k, t in text.items()}
    whole = sum(used.values(), F.lit(0.0))
    score = sum((used[k] * scoring.dot(embed(t), job) for k, t in text.items()), F.lit(0.0)) / F.nullif(whole, F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))), 4)


def skill_overlap(held: Column, wanted: Column, job_text: Column) -> tuple[Column, Column]:
    """Share of a job's skills that are held, and the missing ones; one half if the job names none, 0 without a job."""
    held = F.transform(held, lambda s: F.lower(F.btrim(s)))
    n = F.size(wanted)
    share = F.when(n > 0, F.round(F.size(F.array_intersect(wanted, held)) / F.greatest(n, F.lit(1)), 4)).when(F.btrim(F.coalesce(job_text, F.lit(""))) != "", 0.5).otherwise(0.0)
    return share, F.array_sort(F.array_except(wanted, held))


def match(records: DataFrame, jobs: DataFrame, taxonomy: Sequence[str], weights: dict[str, float] | None = None, lexical: bool = True) -> DataFrame:
    """One row per record and job, with all signals and ``final_match_score``; weights are taken as they are.

    ``records``: id, skills, total_score, vector and text; ``jobs``: job_id, job_text, job_vector.
    """
    weights = {**WEIGHTS, **(weights or {})}
    jobs = jobs.select("job_id", "job_text", "job_vector", extract_skills(F.col("job_text"), taxonomy).alias("wanted"))
    small = jobs.limit(BROADCAST_JOBS + 1).count() <= BROADCAST_JOBS
    met = records.crossJoin(F.broadcast(jobs) if small else jobs)
    if lexical and weights["bm25"]:
        pair = ranking.bm25_pair(records, jobs.select("job_id", F.col("job_text").alias("text")), "id", "text", "job_id").withColumnRenamed("score", "bm25_score")
        met = met.join(pair, ["id", "job_id"])
    else:
        met = met.withColumn("bm25_score", F.lit(0.0))
    blank = (F.btrim(F.coalesce("text", F.lit(""))) == "") | (F.btrim(F.coalesce("job_text", F.lit(""))) == "")
    semantic = F.when(blank, 0.0).otherwise(scoring.similarity(F.col("vector"), F.col("job_vector")))
    share, missing = skill_overlap(F.col("skills"), F.col("wanted"), F.col("job_text"))
    met = met.select("*", semantic.alias("semantic_similarity"), share.alias("skill_overlap"), missing.alias("missing_skills"))
    order = tuple(weights[k] for k in ("semantic", "skill", "rubric", "bm25"))
    final = scoring.blend(F.col("semantic_similarity"), F.col("skill_overlap"), F.col("total_score"), F.col("bm25_score"), order)
    return met.withColumn("final_match_score", final)


def rank(matches: DataFrame, k: int) -> DataFrame:
    """The k best records of each job; ties by id."""
    return ranking.top_k(matches, k, "final_match_score", "id", by="job_id")


def history(rows: DataFrame, mode: str = "rubric") -> DataFrame:
    """Records by rubric or by match, best first; ties by id."""
    by = F.col("total_score") if mode == "rubric" else F.coalesce(F.col("final_match_score"), F.lit(0.0)) * 100
    return rows.orderBy(by.desc(), "id")
