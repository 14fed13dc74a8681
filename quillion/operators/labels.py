"""Labels of training sets: canonical records, tags of tokens, scores and names of files, normalised scores."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import KNOWN_LANGUAGES

#: Kinds of entities; of two at one place the earlier kind wins.
KINDS = ("PERSON", "PROJECT", "CERT", "DEGREE", "INSTITUTION", "TITLE", "COMPANY", "SKILL", "LANGUAGE")


def canon_degree(degree: Column) -> Column:
    """One of Ph.D., MBA, Master, Bachelor and Diploma; empty for all else."""
    low = F.lower(F.btrim(F.coalesce(degree, F.lit(""))))
    return (
        F.when(low.rlike(r"ph\.d|^phd|doctorate|doctor of"), "Ph.D.")
        .when(low.isin("m.b.a", "mba") | low.startswith("mba "), "MBA")
        .when(low.rlike(r"master|m\.eng|mba") | low.isin("ms", "m.s", "msc"), "Master")
        .when(low.rlike(r"^b\.|bachelor") | low.isin("bs", "bsc", "bs.ee", "bs cs"), "Bachelor")
        .when(low.rlike("diploma|associate") | (low == "hnd"), "Diploma")
        .otherwise("")
    )


def canon_skills(skills: Column) -> tuple[Column, Column]:
    """Skills in lower case, each once, without spoken languages; and these languages."""
    names = F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(F.btrim(s))), lambda s: s != "")
    spoken = lambda s: s.isin(*KNOWN_LANGUAGES)
    plain = F.transform(F.filter(names, lambda s: ~spoken(s)), lambda s: F.btrim(F.replace(F.replace(s, F.lit(" / "), F.lit(" ")), F.lit("/"), F.lit(" "))))
    return F.array_distinct(F.filter(plain, lambda s: s != "")), F.filter(names, spoken)


def canon_education(education: Column) -> Column:
    """Entries with their degree's common name; those without one go."""
    return F.filter(F.transform(education, lambda e: e.withField("degree", canon_degree(e["degree"]))), lambda e: e["degree"] != "")


def _spans(text: str, value: str) -> Iterator[tuple[int, int]]:
    words = re.findall(r"[a-z0-9+#.]+", value.lower())
    if len(words) == 1:
        yield from (m.span() for m in re.finditer(rf"\b{re.escape(words[0])}\b", text))
    elif words:
        yield from (m.span() for m in re.finditer(r"[\s,./#+]{1,12}".join(map(re.escape, words)), text))


def tag_tokens(text: str, values: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Tokens between white space, and their tags: of the first tagged character of each."""
    kind_at: dict[int, str] = {}
    for kind, value in sorted(((k, v) for k, v in values if k in KINDS and v), key=lambda x: KINDS.index(x[0])):
        for a, b in _spans(text.lower(), value):
            for at in range(a, b):
                kind_at.setdefault(at, kind)
    tokens, tags, before = [], [], None
    for m in re.finditer(r"\S+", text):
        kind = next((kind_at[at] for at in range(*m.span()) if at in kind_at), None)
        tokens.append(m[0])
        tags.append("O" if kind is None else ("I-" if kind == before else "B-") + kind)
        before = kind
    return tokens, tags


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tag_tokens(t or "", [(v["kind"], v["value"]) for v in values or ()]) for t, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], strings), pa.array([f[1] for f in found], strings)], names=["id", "tokens", "tags"])


def tag_texts(rows: DataFrame, id_col: str, text_col: str, values_col: str) -> DataFrame:
    """Tokens and B-, I- and O tags of each text; ``values_col``: array of (kind, value).  A null text has no tokens."""
    kind = dict(rows.dtypes)[id_col]
    found = rows.select(F.col(id_col).alias("id"), text_col, values_col).mapInArrow(_tagged, f"id {kind}, tokens array<string>, tags array<string>")
    return found.withColumnRenamed("id", id_col)


def score_in(data: Column) -> Column:
    """The score of a JSON answer: final_score, else the first number among the aggregated ones."""
    parts = F.map_values(F.from_json(F.get_json_object(data, "$.scores.aggregated_scores"), "map<string,string>"))
    numbers = F.filter(F.transform(parts, lambda v: v.try_cast("double")), lambda x: x.isNotNull())
    return F.coalesce(F.get_json_object(data, "$.final_score").try_cast("double"), F.get(numbers, F.lit(0)))


def file_kind(path: Column) -> Column:
    """What a file's name starts with: match, mismatch, empty or invalid; else unknown."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    out = F.lit("unknown")
    for kind in ("match", "mismatch", "empty", "invalid"):
        out = F.when(name.startswith(f"{kind}_"), kind).otherwise(out)
    return out


def normalised(rows: DataFrame, score: str, above: float = 1.5) -> DataFrame:
    """Scores divided by their greatest, if that is above a bound."""
    top = rows.agg(F.max(score).alias("_top"))
    scaled = F.when(F.col("_top") > above, F.col(score) / F.col("_top")).otherwise(F.col(score))
    return rows.crossJoin(F.broadcast(top)).withColumn(score, scaled).drop("_top")


def in_percent(rows: DataFrame, score: str) -> DataFrame:
    """Scores times 100, if none is above 1."""
    top = rows.agg(F.max(score).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(score, F.when(F.col("_top") <= 1, F.col(score) * 100).otherwise(F.col(score))).drop("_top")


def split_pair(text: Column, mark: str = " SEP ") -> tuple[Column, Column]:
    """What stands before and after the first mark; the second is null without one."""
    parts = F.split(text, mark, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def name_contains(name: Column, query: str) -> Column:
    """Whether a name holds a text, without regard to case; a null name does not."""
    return F.coalesce(F.contains(F.lower(name), F.lit(query.lower())), F.lit(False))


def corpus(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Labelled tables under one another, each with its source; columns that one lacks are null.

    Rows without a text go; each has the hash of its text.
    """
    from ..functions.text import text_key

    out = None
    for source, rows in parts:
        rows = rows.where(F.btrim(F.coalesce("raw_text", F.lit(""))) != "").select("*", F.lit(source).alias("source"), text_key(F.col("raw_text")).alias("text_hash"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
