"""Sections that hold data instead of prose: JSON, literals of Python, lists of JSON texts, objects in a row.

:func:`as_json` is the one step in Python (literals have no parser in the JVM); all else
reads its JSON with expressions.  What is no data gives null, and the callers then take
their parsers of free text.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .entities import YEAR, _let
from .experience import clean_company, is_open, months_between

NONE = "array<string>"
#: Texts that stand for nothing.
EMPTY = ("", "nan", "[]", "{}")
UNKNOWN = ("unknown", "not provided", "")
_ANY_YEAR = r"\b(?:19|20)\d{2}\b"


def objects_in(text: str) -> list[dict]:
    """All JSON objects that stand in a text one after the other."""
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = read(text, at)
            out.append(found)
        except ValueError:
            at += 1
    return out


def parse_value(raw: str | None) -> dict | list | None:
    """The object or list that a text holds; None if it holds none."""
    if raw is None or raw.strip() in EMPTY:
        return None
    try:
        found = ast.literal_eval(raw.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        try:
            found = json.loads(raw)
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, (dict, list)) else None
    if isinstance(found, dict):
        return found
    if not isinstance(found, (list, tuple)):
        return None
    out = []
    for item in found:
        if isinstance(item, dict):
            out.append(item)
        elif isinstance(item, str):
            try:
                inner = json.loads(item.strip())
                out += [inner] if isinstance(inner, dict) else [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else []
            except (ValueError, RecursionError):
                out += objects_in(item) or [item.strip()]
    return out


def _json(values: pd.Series) -> pd.Series:
    def one(raw: str | None) -> str | None:
        found = parse_value(raw)
        return None if found is None else json.dumps(found, ensure_ascii=False, default=str)

    return values.map(one).astype(object)


def as_json(raw: Column) -> Column:
    """The data of a section as JSON text, an object or array; null if it holds none."""
    # Not moved into the expressions that read it: Spark cannot call Python inside of those over elements.
    return F.pandas_udf(_json, T.StringType()).asNondeterministic()(raw)


def pick(data: Column, *paths: str) -> Column:
    """The first of some paths that is there and not empty, as text; empty if none."""
    return F.coalesce(*[F.nullif(F.get_json_object(data, p), F.lit("")) for p in paths], F.lit(""))


def entries(data: Column) -> Column:
    """The entries of an array as JSON texts (plain texts as they are), or the object as one entry."""
    return F.when(data.startswith("["), F.from_json(data, NONE)).when(data.startswith("{"), F.array(data))


def _objects(data: Column) -> Column:
    return F.filter(entries(data), lambda e: e.startswith("{"))


def _named(value: Column, entry: Column, path: str) -> Column:
    """A text, or the name of the object that stands in its place."""
    return F.when(value.startswith("{"), pick(entry, f"{path}.name")).otherwise(value)


def _list(entry: Column, path: str) -> Column:
    """An array of texts at a path; a single text is one."""
    raw = F.get_json_object(entry, path)
    return F.when(raw.startswith("["), F.from_json(raw, NONE)).when(F.coalesce(raw, F.lit("")) != "", F.array(raw)).otherwise(F.array().cast(NONE))


def experience(data: Column, now: tuple[int, int]) -> Column:
    """Roles of structured data: array of (title, company, start, end, duration_months, description)."""

    def role(e: Column) -> Column:
        start = pick(e, "$.dates.start")
        end = F.btrim(pick(e, "$.dates.end"))
        shown = F.when(is_open(end) & (end != ""), "Present").otherwise(F.coalesce(F.nullif(F.regexp_extract(end, _ANY_YEAR, 0), F.lit("")), F.nullif(end, F.lit(""))))
        months = F.when(F.btrim(start) != "", months_between(start, end, now)).otherwise(0)
        words = lambda path: F.array_join(F.filter(_list(e, path), lambda x: x != ""), ", ")
        parts = [
            F.array_join(F.filter(_list(e, "$.responsibilities"), lambda x: x != ""), "; "),
            words("$.technical_environment.technologies"),
            F.when(words("$.technical_environment.tools") != "", F.concat(F.lit("Tools: "), words("$.technical_environment.tools"))),
        ]
        described = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "; ")
        return F.struct(
            pick(e, "$.title").alias("title"), clean_company(_named(pick(e, "$.company"), e, "$.company")).alias("company"), F.nullif(start, F.lit("")).alias("start"),
            shown.alias("end"), months.alias("duration_months"), described.alias("description"),
        )

    return F.transform(_objects(data), role)


def education(data: Column) -> Column:
    """Entries of structured data: array of (degree, institution, year, gpa, field)."""

    def entry(e: Column) -> Column:
        degree = pick(e, "$.degree", "$.degree_title")
        place = pick(e, "$.institution", "$.university")
        dates = pick(e, "$.dates.expected_graduation", "$.dates.end", "$.dates")
        return F.struct(
            F.btrim(F.when(degree.startswith("{"), pick(e, "$.degree.level", "$.degree_title.level")).otherwise(degree)).alias("degree"),
            F.btrim(F.when(place.startswith("{"), pick(e, "$.institution.name", "$.university.name")).otherwise(place)).alias("institution"),
            F.nullif(F.regexp_extract(dates, _ANY_YEAR, 0), F.lit("")).cast("int").alias("year"), F.nullif(pick(e, "$.achievements.gpa"), F.lit("")).try_cast("double").alias("gpa"),
            F.btrim(pick(e, "$.degree.field")).alias("field"),
        )

    return F.transform(_objects(data), entry)


def projects(data: Column, text: Column) -> Column:
    """Projects of structured data: array of (name, tools, description, link); nameless ones go."""
    first_link = F.nullif(F.regexp_extract(text, r"(?i)github\.com/[\w-]+/[\w-]+", 0), F.lit(""))

    def project(e: Column) -> Column:
        role, body = pick(e, "$.role"), pick(e, "$.description", "$.impact")
        role = F.when(F.lower(role).isin("unknown", ""), "").otherwise(F.concat(F.lit("Role: "), role, F.when(body != "", "; ").otherwise("")))
        tools = F.concat(_list(e, "$.technologies"), F.when(F.size(_list(e, "$.technologies")) == 0, _list(e, "$.tools")).otherwise(F.array().cast(NONE)))
        return F.struct(
            F.btrim(pick(e, "$.name", "$.title")).alias("name"), F.filter(tools, lambda t: (t != "") & (F.lower(t) != "unknown")).alias("tools"),
            F.btrim(F.concat(role, body)).alias("description"), F.coalesce(F.nullif(pick(e, "$.url", "$.link"), F.lit("")), first_link).alias("link"),
        )

    return F.filter(F.transform(_objects(data), project), lambda p: ~F.lower(p["name"]).isin(*UNKNOWN))


def certifications(data: Column) -> Column:
    """Certifications of structured data: array of (name, issuer, year)."""

    def one(e: Column) -> Column:
        issuer = pick(e, "$.issuer", "$.issuing_organization")
        year = F.coalesce(pick(e, "$.year").try_cast("int"), F.regexp_extract(pick(e, "$.date"), YEAR, 1).try_cast("int"))
        return F.struct(F.btrim(pick(e, "$.name")).alias("name"), F.btrim(_named(issuer, e, "$.issuer")).alias("issuer"), year.alias("year"))

    return F.filter(F.transform(_objects(data), one), lambda c: ~F.lower(c["name"]).isin(*UNKNOWN))


def languages(data: Column) -> Column:
    """Languages of structured data: array of (language, proficiency)."""
    inner = F.coalesce(*[F.when(F.get_json_object(data, f"$.{k}").startswith("["), F.get_json_object(data, f"$.{k}")) for k in ("languages", "spoken_languages", "language_skills")])
    listed = F.from_json(F.when(data.startswith("["), data).otherwise(inner), NONE)
    level = lambda e: F.nullif(F.btrim(pick(e, "$.level", "$.proficiency")), F.lit(""))
    struct = lambda a, b: F.struct(a.alias("language"), b.alias("proficiency"))
    return F.transform(listed, lambda e: F.when(e.startswith("{"), struct(F.btrim(pick(e, "$.name", "$.language")), level(e))).otherwise(struct(e, F.lit(None).cast("string"))))


def skills(data: Column) -> Column:
    """Skills of structured data in lower case: of each technical category and the languages, or of a list."""
    categories = F.from_json(F.get_json_object(data, "$.technical"), "map<string,string>")
    grouped = F.flatten(F.transform(F.map_values(categories), lambda v: F.when(v.startswith("["), F.from_json(v, NONE)).otherwise(F.array().cast(NONE))))
    spoken = F.coalesce(F.from_json(F.get_json_object(data, "$.languages"), NONE), F.array().cast(NONE))
    found = F.when(data.startswith("{"), F.concat(F.coalesce(grouped, F.array().cast(NONE)), spoken)).otherwise(F.from_json(data, NONE))
    names = F.transform(found, lambda e: F.lower(F.btrim(F.replace(F.when(e.startswith("{"), pick(e, "$.name", "$.skill")).otherwise(e), F.lit("\\/"), F.lit("/")))))
    kept = F.filter(names, lambda s: ~s.isin(*UNKNOWN))
    return F.when(F.size(kept) > 0, kept)


def items(data: Column, keys: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """Texts of a list, or of the list under one of some keys; of objects the first of some fields."""
    inner = F.coalesce(*[F.get_json_object(data, f"$.{k}") for k in keys])
    listed = F.when(data.startswith("["), F.from_json(data, NONE)).when(inner.startswith("["), F.from_json(inner, NONE)).when(inner.isNotNull(), F.split(inner, "\n"))
    texts = F.transform(listed, lambda e: F.when(e.startswith("{"), F.btrim(pick(e, *[f"$.{f}" for f in fields]))).otherwise(F.btrim(F.btrim(e), F.lit("'\""))))
    return F.filter(texts, lambda t: ~F.lower(t).isin("", "nan"))


def name(data: Column) -> Column:
    """The name of personal data; empty if unknown."""
    return _let(pick(data, "$.name"), lambda n: F.when(F.lower(n).isin(*UNKNOWN), "").otherwise(n))
