"""Two extractions of one profile made into one, and repairs of what a language model answers.

All in expressions, but for :func:`parse_answer`, which looks for JSON in prose.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_grounded
from .entities import _let
from .experience import MONTHS, _NAMES
from .structured import objects_in

#: Names of degrees by what a text starts with or holds, in order of search.
DEGREE_NAMES = {
    "ph.d": "Ph.D.", "phd": "Ph.D.", "doctorate": "Ph.D.", "doctor of": "Ph.D.",
    "mba": "MBA",
    "master": "Master", "msc": "Master", "m.s": "Master", "m.eng": "Master",
    "b.tech": "Bachelor", "b.e": "Bachelor", "b.sc": "Bachelor", "b.a": "Bachelor",
    "bachelor": "Bachelor",
    "diploma": "Diploma", "associate": "Diploma",
}


def canon_degree(degree: Column) -> Column:
    """The common name of a degree; others stay, null is empty."""
    low = F.lower(F.btrim(F.coalesce(degree, F.lit(""))))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in DEGREE_NAMES.items()], degree, F.lit(""))


def _month(mark: Column, without: int) -> Column:
    """Months since year 0 of a mark; one with a year alone counts as ``without``."""
    named = F.lower(F.regexp_extract(mark, rf"(?i)({_NAMES})[a-z]*[.,]?\s+\d{{4}}", 1))
    year = F.coalesce(F.regexp_extract(mark, rf"(?i)(?:{_NAMES})[a-z]*[.,]?\s+(\d{{4}})", 1).try_cast("int"), F.regexp_extract(mark, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int"))
    return year * 12 + F.when(named != "", F.array_position(F.array(*map(F.lit, MONTHS)), named).cast("int")).otherwise(without)


def fill_months(roles: Column, now: tuple[int, int]) -> Column:
    """Durations where they are missing or 0: a year alone starts in January and ends in December; no end, no duration."""

    def months(r: Column) -> Column:
        open_end = F.lower(F.btrim(r["end"])).isin("present", "current", "till date", "now")
        last = F.when(open_end, now[0] * 12 + now[1]).otherwise(_month(r["end"], 12))
        return F.coalesce(F.greatest(F.lit(0), last - _month(r["start"], 1)), F.lit(0))

    return F.transform(roles, lambda r: r.withField("duration_months", F.when(F.coalesce(r["duration_months"], F.lit(0)) > 0, r["duration_months"]).otherwise(months(r)).cast("int")))


def distinct_by(items: Column, key) -> Column:
    """Entries in order, the first of each key; entries without a key go."""
    return _let(items, lambda a: _let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: (F.btrim(key(x)) != "") & (F.array_position(keys, key(x)) == i + 1))))


def fuse(rules: Column, learned: Column) -> dict[str, Column]:
    """Fields of one record from two of one shape.

    Single values: learned first.  Skills, projects, certifications, languages: ordered
    union.  Experience, education: the side with more complete entries, learned on ties.
    Leadership and achievements: rules.
    """
    key = lambda *names: lambda x: F.lower(F.concat_ws(" ", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names]))
    first = lambda n: F.coalesce(F.nullif(learned[n], F.lit("")), rules[n])
    both = lambda n, k: distinct_by(F.concat(rules[n], learned[n]), k)

    def longer(n: str, need: str, k) -> Column:
        a, b = (F.filter(side[n], lambda x: F.coalesce(x[need] != "", F.lit(False))) for side in (rules, learned))
        return distinct_by(F.when(F.size(b) >= F.size(a), b).otherwise(a), k)

    return {
        "name": first("name"), "email": first("email"), "phone": first("phone"), "skills": both("skills", F.lower), "projects": both("projects", key("name")),
        "certifications": both("certifications", key("name")), "languages": both("languages", key("language")),
        "experience": longer("experience", "title", key("title", "company")), "education": longer("education", "degree", key("degree", "institution")),
        "leadership": rules["leadership"], "achievements": rules["achievements"],
    }


def grounded(skills: Column, text: Column) -> Column:
    """Skills in lower case that a text shows."""
    names = F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(F.btrim(s))), lambda s: s != "")
    return F.filter(names, lambda s: is_grounded(s, text))


def education_gaps(education: Column, degrees: Column, institutions: Column) -> Column:
    """Degrees and institutions that were tagged, paired by position, without those already known."""
    key = lambda a, b: F.lower(F.concat(F.coalesce(a, F.lit("")), F.lit("|"), F.coalesce(b, F.lit(""))))
    known = F.transform(education, lambda e: key(e["degree"], e["institution"]))
    pairs = F.transform(degrees, lambda d, i: F.struct(d.alias("degree"), F.get(institutions, i).alias("institution")))
    new = F.filter(pairs, lambda p: (p["degree"] != "") & ~F.array_contains(known, key(p["degree"], p["institution"])))
    return distinct_by(new, lambda p: key(p["degree"], p["institution"]))


def _answer(values: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        found = objects_in(text or "")
        return json.dumps(found[0], ensure_ascii=False) if found else None

    return values.map(one).astype(object)


def parse_answer(text: Column) -> Column:
    """The first JSON object in an answer, as JSON; null if there is none."""
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull() & F.btrim(text).startswith("{"), text), F.pandas_udf(_answer, T.StringType())(text))
