"""Headings and sections of a text.

The heading map is a parameter: aliases by section, in order of precedence.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK
from .entities import _let

#: Default headings by section; the first section with a matching alias wins.
HEADINGS = {
    "education": (
        "education",
        "educational background",
        "academic background",
        "academic history",
        "qualifications",
        "academic qualifications",
        "degrees",
    ),
    "experience": (
        "experience",
        "work experience",
        "professional experience",
        "employment history",
        "employment",
        "work history",
        "career history",
        "professional background",
        "professional history",
        "internships",
        "internship experience",
        "industry experience",
        "relevant experience",
        "teaching experience",
        "research experience",
        "professional roles",
        "work placements",
        "employment experience",
    ),
    "skills": (
        "skills",
        "technical skills",
        "core skills",
        "key skills",
        "skill set",
        "skillset",
        "competencies",
        "core competencies",
        "technologies",
        "tools",
        "tools & technologies",
        "tools and technologies",
        "programming languages",
        "technical expertise",
        "areas of expertise",
        "expertise",
        "skill highlights",
        "technical proficiencies",
        "proficiencies",
    ),
    "projects": (
        "projects",
        "project experience",
        "personal projects",
        "academic projects",
        "side projects",
        "portfolio",
        "selected projects",
        "key projects",
    ),
    "certifications": (
        "certifications",
        "certification",
        "certificates",
        "professional certifications",
        "licenses",
        "licenses & certifications",
        "licenses and certifications",
        "accreditations",
        "courses",
        "training",
    ),
    "languages": (
        "languages",
        "language skills",
        "spoken languages",
    ),
    "achievements": (
        "achievements",
        "accomplishments",
        "honors",
        "honours",
        "awards",
        "awards & honors",
        "awards and honors",
        "academic achievements",
        "recognition",
        "publications",
        "selected publications",
        "peer-reviewed publications",
        "invited talks",
        "invited presentations",
        "presentations",
        "conferences",
        "conference presentations",
        "workshops",
        "talks",
        "research interests",
    ),
    "leadership": (
        "leadership",
        "leadership experience",
        "extracurricular",
        "extracurricular activities",
        "activities",
        "volunteering",
        "volunteer experience",
        "community involvement",
        "clubs",
        "organizations",
        "memberships",
    ),
    "summary": (
        "summary",
        "professional summary",
        "executive summary",
        "objective",
        "career objective",
        "profile",
        "professional profile",
        "about me",
        "overview",
        "introduction",
    ),
    "references": (
        "references",
        "referees",
    ),
}
#: All sections in their order of output.
CANONICAL_SECTIONS = (
    "header", "summary", "education", "experience", "skills", "projects", "certifications", "languages", "achievements", "leadership", "references", "other",
)
#: What starts a bullet and ends a sentence.
BULLET_LINE = r"^[-*•·–—>]"
SENTENCE_END = r"[.?!]$"
MOST_CHARS = 60


def heading(line: Column, headings=HEADINGS) -> Column:
    """The section that a line heads, or null.

    A heading is short, no bullet and no sentence.  A whole alias comes before aliases
    inside the line; several words match anywhere, a single word as a word.
    """
    body = F.btrim(line)
    # Longer lines, bullets and sentences need no more looking at, and what is left is made plain once.
    fits = (F.length(body) <= MOST_CHARS) & ~body.rlike(BULLET_LINE) & ~body.rlike(SENTENCE_END)

    several = {section: [n for n in names if " " in n] for section, names in headings.items()}
    single = {section: [n for n in names if " " not in n] for section, names in headings.items()}
    word = lambda names: r"\b(?:" + "|".join(map(re.escape, names)) + r")\b"

    def named(x: Column) -> Column:
        """One test for all sections goes before those of each: most lines fail all three."""
        plain, whole, inside = x["plain"], [], []
        for section, names in headings.items():
            whole.append(F.when(x["alias"] & plain.isin(*names), section))
            test = x["blank"] & reduce(or_, [plain.contains(n) for n in several[section]], F.lit(False))
            if single[section]:
                test = test | (x["word"] & plain.rlike(word(single[section])))
            inside.append(F.when(test, section))
        return F.coalesce(*whole, *inside)

    def tests(plain: Column) -> Column:
        of = lambda names: sum(names.values(), [])
        held = plain.rlike(word(of(single))) if of(single) else F.lit(False)
        parts = F.struct(plain.alias("plain"), plain.isin(*sum(map(list, headings.values()), [])).alias("alias"), plain.contains(" ").alias("blank"), held.alias("word"))
        return F.when(plain != "", _let(parts, named))

    # Blanks that stand alone are left as they are, which is most of them.
    spaced = lambda x: F.when(x.rlike(r"\s\s|[^\S ]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)
    plain = _let(F.rtrim(F.lower(body), F.lit(":")), spaced)
    return F.when(fits, _let(F.btrim(F.btrim(plain, F.lit("-_=•"))), tests))


def split_sections(docs: DataFrame, text_col: str = "text", headings=HEADINGS) -> DataFrame:
    """Add ``sections``: a map of section to text; ``header`` is always there.

    The fold over lines runs inside each row: nothing is exploded or shuffled.  Parts of
    one section are joined in order; empty sections are left out.
    """
    lines = F.split(F.coalesce(text_col, F.lit("")), LINE_BREAK)
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), heading(x, headings).alias("head")))
    start = F.struct(F.lit("header").alias("now"), F.array().cast("array<struct<s:string,l:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        added = F.when(x["head"].isNull(), F.concat(state["out"], F.array(F.struct(state["now"].alias("s"), x["line"].alias("l"))))).otherwise(state["out"])
        return F.struct(F.coalesce(x["head"], state["now"]).alias("now"), added.alias("out"))

    names = [n for n in CANONICAL_SECTIONS if n == "header" or n in headings] + [n for n in headings if n not in CANONICAL_SECTIONS]

    def filled(placed: Column) -> Column:
        def body(name: Column) -> Column:
            own = F.transform(F.filter(placed, lambda p: p["s"] == name), lambda p: p["l"])
            return F.btrim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))

        each = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(n, body(n)))
        return F.map_filter(F.map_from_entries(each), lambda k, v: (v != "") | (k == "header"))

    # The lines are placed once, and not again for each section.
    found = F.transform(F.array(F.aggregate(marked, start, step)["out"]), filled)
    return docs.withColumn("sections", F.get(found, F.lit(0)))


def section(sections: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(sections, F.lit(name)), F.lit(""))
