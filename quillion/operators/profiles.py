"""From the text of a profile to a scored record, and what is derived from such records.

A record is a struct: cv_id, raw_text, language, name, email, phone, education, experience,
skills, projects, certifications, languages, achievements, leadership.  Each field takes
structured data where its section holds some, else free text.  Null texts give empty fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as T
from . import entities, experience, people, skills, structured
from .entities import _let, _lines
from .sections import section, split_sections

#: Sections that may hold structured data.
STRUCTURED = ("personal_info", "skills", "education", "experience", "projects", "certifications", "languages", "achievements", "leadership")
FIELDS = (
    "cv_id", "raw_text", "language", "name", "email", "phone", "education", "experience", "skills", "projects", "certifications", "languages", "achievements", "leadership",
)
#: Fields that scores and features are made from.
SCORED = ("education", "experience", "skills", "projects", "certifications", "languages", "leadership")
#: Roles of leadership among the lines on experience.
LED = r"(?i)\b(?:led|mentored|headed|supervised)\s+(?:a\s+|the\s+)?(?:team|group)\b"
NONE = "array<string>"


def _first_filled(*arrays: Column) -> Column:
    """The first array that has entries, else an empty one."""
    first, *rest = arrays
    return _let(first, lambda a: F.when(F.size(a) > 0, a).otherwise(_first_filled(*rest))) if rest else first


def _first_of(items: Column, key) -> Column:
    """Of entries with one key the first stays; all without a key stay."""
    return _let(items, lambda a: _let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: (key(x) == "") | (F.array_position(keys, key(x)) == i + 1))))


def extract(
    rows: DataFrame, now: tuple[int, int], taxonomy: Sequence[str], text_col: str = "text", sections_col: str | None = None, first_names: Sequence[str] = (), fields: Sequence[str] = FIELDS,
) -> DataFrame:
    """Add ``cv``, the record of each text; sections are split from it if none are given.

    ``fields``: those that the record is to have.  The others are neither planned nor computed.
    """
    if sections_col is None:
        sections_col = "sections"
        # The row number keeps the split a step of its own: Python below cannot be given what is still to be folded.
        rows = split_sections(rows, text_col).withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")
    own = lambda name: section(F.col(sections_col), name)
    rows = rows.select("*", *[structured.as_json(own(s)).alias(f"_json_{s}") for s in STRUCTURED])
    data = {s: F.col(f"_json_{s}") for s in STRUCTURED}
    text = F.coalesce(F.col(text_col), F.lit(""))
    free = lambda name, found: F.when(data[name].isNull(), found)
    contact = lambda name: T.contacts(text)[name]

    def held_skills() -> Column:
        summary = structured.pick(data["personal_info"], "$.summary")
        listed = F.concat(
            F.coalesce(structured.skills(data["skills"]), F.array().cast(NONE)), F.when(F.lower(summary).isin(*structured.UNKNOWN), F.array().cast(NONE)).otherwise(skills.extract_skills(summary, taxonomy))
        )
        return F.array_sort(F.array_distinct(_first_filled(listed, skills.extract_skills(text, taxonomy))))

    def tongues() -> Column:
        return _first_filled(
            F.coalesce(structured.languages(data["languages"]), free("languages", entities.languages(own("languages")))),
            structured.languages(F.when(data["skills"].startswith("{"), data["skills"])), free("skills", entities.languages(own("skills"))),
        )

    def awards() -> Column:
        return F.coalesce(structured.items(data["achievements"], ("achievements", "accomplishments", "awards", "honors"), ("title", "name", "description")), free("achievements", F.filter(_lines(own("achievements")), lambda x: F.lower(x) != "nan")))

    def lead() -> Column:
        led = F.filter(_lines(own("experience")), lambda x: x.rlike(LED))
        roles = F.coalesce(structured.items(data["leadership"], ("leadership", "extracurricular", "volunteering", "activities"), ("title", "name", "role", "description")), free("leadership", F.filter(_lines(own("leadership")), lambda x: F.lower(x) != "nan")))
        return entities.merged(entities.leadership(roles), led)

    found = {
        "cv_id": lambda: F.substring(F.md5(text.cast("binary")), 1, 12), "raw_text": lambda: text, "language": lambda: F.lit("en"),
        "name": lambda: F.coalesce(F.nullif(structured.name(data["personal_info"]), F.lit("")), people.name_from_text(text, taxonomy, first_names)),
        "email": lambda: contact("email"), "phone": lambda: contact("phone"),
        "education": lambda: _first_filled(structured.education(data["education"]), entities.education(own("education"))),
        "experience": lambda: _first_filled(structured.experience(data["experience"], now), experience.experience(own("experience"), now)),
        "skills": held_skills,
        "projects": lambda: F.coalesce(structured.projects(data["projects"], own("projects")), entities.projects(own("projects"), tuple(taxonomy))),
        "certifications": lambda: _first_of(F.coalesce(structured.certifications(data["certifications"]), entities.certifications(own("certifications"))), lambda c: F.lower(F.btrim(c["name"]))),
        "languages": tongues, "achievements": awards, "leadership": lead,
    }
    # Fields are columns first: a struct's fields would be computed anew wherever they are read.
    kept = [c for c in rows.columns if not c.startswith("_json_")]
    rows = rows.select(*kept, *[found[n]().alias(f"_cv_{n}") for n in fields])
    return rows.select(*kept, F.struct(*[F.col(f"_cv_{n}").alias(n) for n in fields]).alias("cv"))


def score(rows: DataFrame, cv_col: str = "cv") -> DataFrame:
    """Add criteria_scores, total_score, label and suggestions of each record."""
    cv = F.col(cv_col)
    scores = scoring.profile_scores(cv)
    total = scoring.total(scores)
    return rows.select(
        "*", scoring.criteria(scores, scoring.rationales(cv)).alias("criteria_scores"), total.alias("total_score"), scoring.label(total).alias("label"), scoring.suggestions(scores).alias("suggestions")
    )


def features(rows: DataFrame, cv_col: str = "cv") -> DataFrame:
    """Nine measures of the text and twelve of the record, as columns."""
    cv = F.col(cv_col)
    named = {**T.macro_features(cv["raw_text"]), **scoring.profile_features(cv)}
    return rows.select("*", *[c.alias(n) for n, c in named.items()])


def as_text(cv: Column) -> Column:
    """The text of a record, or what its fields say where it has none."""
    words = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    parts = F.concat(
        F.transform(cv["experience"], lambda e: words(e["title"], e["company"], e["description"])), F.transform(cv["education"], lambda e: words(e["degree"], e["field"], e["institution"])),
        F.transform(cv["projects"], lambda p: words(p["name"], p["description"])), F.array(F.array_join(cv["skills"], ", ")),
    )
    return F.coalesce(F.nullif(cv["raw_text"], F.lit("")), F.array_join(F.filter(parts, lambda p: p != ""), " "))


def populated(cv: Column, names: Sequence[str]) -> Column:
    """How many of some list fields hold an entry with at least one value that is no placeholder."""
    def filled(name: str) -> Column:
        text = F.lower(F.to_json(cv[name]))
        return text.rlike(r'(?::|\[|,)"(?!\s*(?:unknown|not provided|nan)?\s*")').cast("int")

    return sum((F.coalesce(filled(n), F.lit(0)) for n in names), F.lit(0))
