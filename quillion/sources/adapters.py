"""Tables of other makers' profiles as sections and texts, and texts rebuilt from structured columns.

Columns hold JSON, literals of Python or prose; what is no data counts as absent, so no row
is lost.  Nulls and the placeholders of ``NOTHING`` count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import structured
from ..operators.entities import _let

#: Texts that stand for nothing, the order of a flattened row, and headings.
NOTHING = ("", "unknown", "not provided", "none", "nan")
FLAT = ("personal_info", "experience", "education", "skills", "projects", "certifications", "achievements")
BLANK = ("", "[]", "{}", "nan")
#: Keys that one source has for the places that the parsers look at.
RENAMED = {"end_date": ("dates", "end"), "degree_title": ("degree", "level"), "university": ("institution", "name")}

_TEXTS = "array<string>"


def _present(value: Column, nothing: tuple[str, ...] = ("", "nan")) -> Column:
    """The text of a column, or null for a placeholder."""
    return F.when(~F.lower(value).isin(*nothing), value)


def _said(value: Column) -> Column:
    text = F.btrim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(text).isin(*NOTHING), "").otherwise(text)


def _entries(data: Column) -> Column:
    """Entries of a JSON array as texts; an object is its only entry."""
    return F.coalesce(F.when(data.startswith("["), F.from_json(data, _TEXTS)).when(data.startswith("{"), F.array(data)), F.array().cast(_TEXTS))


def _renamed(entry: Column) -> Column:
    """An entry with the other source's keys in the parsers' places; a place that is taken stays."""
    def without(pairs: Column, key: str) -> Column:
        return F.map_filter(pairs, lambda k, _: k != key)

    have = F.from_json(entry, "map<string,string>")
    for old, (new, inner) in RENAMED.items():
        moved = F.map_from_arrays(F.array(F.lit(new)), F.array(F.to_json(F.map_from_arrays(F.array(F.lit(inner)), F.array(F.element_at(have, old))))))
        keep = F.map_contains_key(have, old) & ~F.map_contains_key(have, new)
        have = F.when(keep, F.map_concat(without(have, old), moved)).otherwise(have)
    return have


def netsol(rows: DataFrame) -> DataFrame:
    """Add ``sections`` and ``text`` to rows of candidate_name, skills, education, experience, job_description (certifications where there are any)."""
    named = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    name, job = _present(named("candidate_name")), _present(named("job_description"))
    skills, taught = _present(named("skills")), _present(named("education"))
    done, papers = _present(named("experience"), ("", "nan", "[]")), _present(named("certifications"), ("", "nan", "[]"))
    # Values that are themselves objects stay JSON texts inside; the parsers read both.
    entries = F.transform(F.filter(_entries(taught), lambda e: e.startswith("{")), _renamed)
    school = F.when(taught.isNotNull(), F.to_json(entries))
    person = F.when(name.isNotNull(), F.to_json(F.struct(name.alias("name"))))
    found = {"personal_info": person, "skills": skills, "education": school, "experience": done, "certifications": papers}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in found.items()]), lambda p: p["v"].isNotNull())
    said = [("Name", name), ("Skills", skills), ("Education", school), ("Experience", done), ("Certifications", papers), ("Job Description", job)]
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{k}: "), v) for k, v in said])
    return rows.select("*", F.map_from_entries(pairs).alias("sections"), text.alias("text"))


def plain(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that are texts only: no sections, and a null text is empty."""
    rest = [c for c in rows.columns if c not in (text_col, "text", "sections")]
    return rows.select(*rest, F.create_map().cast("map<string,string>").alias("sections"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def flatten(row: dict[str, Column]) -> Column:
    """The filled columns of a row after one another, with blanks between."""
    return F.concat_ws(" ", *[F.when(~F.btrim(row[c]).isin(*BLANK), row[c]) for c in FLAT if c in row])


def _field(entry: Column, path: str) -> Column:
    return _said(F.get_json_object(entry, path))


def _after(mark: str, value: Column, end: str = "") -> Column:
    return F.when(value != "", F.concat(F.lit(mark), value, F.lit(end))).otherwise("")


def _either(entry: Column, key: str, inner: str) -> Column:
    """A field's inner value where it is an object, else the field."""
    whole = _field(entry, f"$.{key}")
    return F.when(whole.startswith("{"), _field(entry, f"$.{key}.{inner}")).otherwise(whole)


def _role(e: Column) -> Column:
    start, end = _field(e, "$.dates.start"), _field(e, "$.dates.end")
    when = F.when((start != "") | (end != ""), F.concat(F.lit(" | "), start, F.lit(" - "), end)).otherwise("")
    duties = F.transform(F.from_json(F.get_json_object(e, "$.responsibilities"), _TEXTS), _said)
    listed = F.transform(F.filter(F.coalesce(duties, F.array().cast(_TEXTS)), lambda d: d != ""), lambda d: F.concat(F.lit("  - "), d))
    return F.concat(F.array(F.concat(_field(e, "$.title"), _after(" at ", _field(e, "$.company")), when)), listed)


def _school(e: Column) -> Column:
    degree = F.btrim(F.concat_ws(" ", _either(e, "degree", "level"), F.when(_field(e, "$.degree").startswith("{"), _field(e, "$.degree.field"))))
    return F.array(F.concat(degree, _after(" at ", _either(e, "institution", "name")), _after(" (", _field(e, "$.dates.expected_graduation"), ")")))


def _project(e: Column) -> Column:
    tools = F.coalesce(F.get_json_object(e, "$.technologies"), F.get_json_object(e, "$.tools"))
    named = F.array_join(F.filter(F.transform(F.coalesce(F.from_json(F.when(tools.startswith("["), tools), _TEXTS), F.array().cast(_TEXTS)), _said), lambda t: t != ""), ", ")
    about = _field(e, "$.description")
    return F.concat(F.array(F.concat(_field(e, "$.name"), _after(" [", named, "]"))), F.when(about != "", F.array(F.concat(F.lit("  "), about))).otherwise(F.array().cast(_TEXTS)))


def _paper(e: Column) -> Column:
    return F.array(F.when(e.startswith("{"), F.concat(_field(e, "$.name"), _after(" - ", _field(e, "$.issuer")))).otherwise(e))


def _prize(e: Column) -> Column:
    return F.array(F.when(e.startswith("{"), F.coalesce(F.nullif(_field(e, "$.name"), F.lit("")), _field(e, "$.description"))).otherwise(e))


def _all_skills(data: Column) -> Column:
    groups = F.map_values(F.from_json(F.get_json_object(data, "$.technical"), "map<string,string>"))
    grouped = F.flatten(F.transform(F.filter(groups, lambda g: g.startswith("[")), lambda g: F.from_json(g, _TEXTS)))
    named = F.transform(grouped, lambda s: F.when(s.startswith("{"), _field(s, "$.name")).otherwise(_said(s)))
    listed = F.transform(F.filter(F.from_json(F.when(data.startswith("["), data), _TEXTS), lambda s: ~s.startswith("{")), _said)
    return F.filter(F.coalesce(F.when(data.startswith("{"), named), listed, F.array().cast(_TEXTS)), lambda s: s != "")


def rebuild(rows: DataFrame, to: str = "text") -> DataFrame:
    """Add the text of a profile that structured columns describe, with a heading for each part that is there."""
    rows = rows.select("*", *[structured.as_json(F.col(c)).alias(f"_json_{c}") for c in FLAT if c in rows.columns])
    data = lambda c: F.col(f"_json_{c}") if f"_json_{c}" in rows.columns else F.lit(None).cast("string")
    none = F.array().cast(_TEXTS)
    person = data("personal_info")
    about = _field(person, "$.summary")
    head = F.concat(F.filter(F.array(_field(person, "$.name"), _field(person, "$.email")), lambda x: x != ""), F.when(about != "", F.array(F.lit("SUMMARY"), about)).otherwise(none))

    def part(column: str, heading: str, lines, objects: bool = True) -> Column:
        def body(entries: Column) -> Column:
            used = F.filter(entries, lambda e: e.startswith("{")) if objects else entries
            return F.when(F.size(entries) > 0, F.concat(F.array(F.lit(heading)), F.flatten(F.transform(used, lines)))).otherwise(none)

        return _let(_entries(data(column)), body)

    listed = _let(_all_skills(data("skills")), lambda s: F.when(F.size(s) > 0, F.array(F.lit("SKILLS"), F.array_join(s, ", "))).otherwise(none))
    parts = [
        head, part("experience", "EXPERIENCE", _role), part("education", "EDUCATION", _school), listed, part("projects", "PROJECTS", _project),
        part("certifications", "CERTIFICATIONS", _paper, False), part("achievements", "ACHIEVEMENTS", _prize, False),
    ]
    kept = [c for c in rows.columns if not c.startswith("_json_") and c != to]
    return rows.select(*kept, F.array_join(F.concat(*parts), "\n").alias(to))
