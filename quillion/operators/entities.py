"""Entities from section texts: certifications, languages, leadership, and the fusion of two extractions.

Every function maps columns to columns and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a line as a certification.
CERT_KEYWORDS = (
    "certified", "certificate", "certification", "aws", "google cloud",
    "azure", "pmp", "cissp", "comptia", "coursera", "udemy", "edx",
    "oracle", "ccna", "ccnp", "ceh", "oscp", "itil", "six sigma",
    "scrum master", "cfa", "cpa", "frm", "prince2",
)
#: Levels of proficiency, in order of search.
LANG_PROFICIENCY = (
    "native", "fluent", "proficient", "intermediate", "beginner",
    "a1", "a2", "b1", "b2", "c1", "c2",
)
#: Spoken languages, in order of search.
KNOWN_LANGUAGES = (
    "english", "spanish", "french", "german", "chinese", "mandarin",
    "japanese", "korean", "arabic", "russian", "portuguese", "italian",
    "dutch", "bengali", "hindi", "urdu", "punjabi", "tamil", "telugu",
    "marathi", "gujarati", "persian", "turkish", "vietnamese", "thai",
    "polish", "ukrainian", "romanian", "czech", "greek", "hungarian",
    "swedish", "danish", "norwegian", "finnish", "hebrew", "indonesian",
    "malay", "tagalog", "swahili", "burmese", "khmer", "nepali", "sinhala",
)
#: Headers of lines that list techniques and not spoken languages.
TECH_CATEGORY_HEADERS = (
    "frameworks", "databases", "tools", "other",
    "technologies", "programming languages", "libraries",
    "platforms", "devops", "cloud", "ides", "editors",
    "backend", "frontend", "full-stack", "stacks",
    "languages & frameworks", "tools & technologies",
    "tech stack", "technical skills", "core competencies",
    "programming", "software", "web", "mobile",
)
#: A language with its level in brackets, a year, starts of mere membership.
LANG_PAREN = r"([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*[\(\[,]\s*([A-Za-z0-9+/]+)\s*[\)\]]"
#: The same language matched from the start of each run of words only, without groups that repeat:
#: linear on very long lines, and no recursion in the JVM.
LANG_IN_BRACKETS = r"(?<![A-Za-z\s])\s*([A-Za-z](?:[A-Za-z\s]*[A-Za-z])?)\s*[\(\[,]\s*([A-Za-z0-9+/]+)\s*[\)\]]"
YEAR = r"\b(20\d{2})\b"
MEMBER_STARTS = ("member", "volunteer", "participant", "attended", "server")
#: Names of degrees and how each is written, in order of search.
DEGREES = {
    "phd": "PhD", "ph.d": "PhD", "doctor of philosophy": "PhD",
    "master": "Master", "master's": "Master", "masters": "Master",
    "m.sc": "M.Sc", "m.s.": "M.Sc", "mba": "MBA",
    "m.tech": "M.Tech", "m.e": "M.E", "m.a": "M.A",
    "bachelor": "Bachelor", "bachelor's": "Bachelor", "bachelors": "Bachelor",
    "b.sc": "B.Sc", "b.s.": "B.Sc", "b.tech": "B.Tech",
    "b.e": "B.E", "b.a": "B.A",
    "diploma": "Diploma", "associate": "Associate",
    "hsc": "HSC", "ssc": "SSC", "high school": "High School",
}
#: Fields of study, in order of search.
FIELDS = (
    "computer science", "computer engineering",
    "electrical", "mechanical", "civil", "chemical",
    "electronics", "information technology", "data science",
    "mathematics", "physics", "biology", "business",
    "commerce", "arts", "engineering", "science",
)
#: What marks a line as an institution.
INSTITUTIONS = (
    "university", "college", "institute", "school", "academy",
    "polytechnic", "iit", "nit", "iiit", "buet", "mit", "stanford",
    "harvard", "oxford", "cambridge", "delft", "eth", "nus",
    "vit", "bits", "iisc", "nsit", "dtu", "ipu", "amu", "jnu",
    "bhu", "du",
)
#: Patterns of education and project texts.
ANY_YEAR = r"\b(?:19|20)\d{2}\b"
YEAR_SPAN = r"(?i)(\d{4})\s*[-–to]+\s*(\d{4}|Present|Expected)"
GPA = r"(?i)(?:gpa|cgpa|g\.p\.a)[:\s]*([\d]+\.[\d]+)"
ENTRY_BREAK = r"\n\s*\n|(?:\d+[.)]\s*)"
GITHUB = r"(?i)github\.com/[\w-]+/[\w-]+"
TITLE_SEPARATOR = r"\s[-–]\s+[A-Za-z0-9+#]|\s\([A-Za-z0-9#]|\s\+\s|github\.com"
BULLET_START = r"^\s*(?:[-•*o])\s+"

SPACES = " \t\n\r\f\x0b"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside of functions over elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    """Trimmed lines of a text that are not blank."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.filter(lines, lambda x: x != "")


def _first_held(line: Column, words: tuple[str, ...]) -> Column:
    """The first word of a list that a line contains; null if none."""
    return F.coalesce(*[F.when(F.contains(line, F.lit(w)), F.lit(w)) for w in words])


def certifications(text: Column) -> Column:
    """Lines that name a certification: array of (name, issuer, year).  Null and blank texts have none."""
    held = F.filter(_lines(text), lambda x: F.lower(x).rlike("|".join(CERT_KEYWORDS)))
    year = lambda x: F.nullif(F.regexp_extract(x, YEAR, 1), F.lit("")).cast("int")
    return F.transform(held, lambda x: F.struct(x.alias("name"), F.lit("").alias("issuer"), year(x).alias("year")))


def _language(line: Column) -> Column:
    """(language, proficiency) of a line, or null: bracketed level, then a comma, then any known name."""
    none = F.lit(None).cast("string")
    pair = lambda a, b: F.struct(a.alias("language"), b.alias("proficiency"))
    named = lambda x: F.lower(x).isin(*KNOWN_LANGUAGES)
    low = F.lower(line)
    in_brackets = F.btrim(F.regexp_extract(line, LANG_IN_BRACKETS, 1), F.lit(SPACES))
    before = F.btrim(F.substring_index(line, ",", 1), F.lit(SPACES))
    after = F.btrim(F.substring(line, F.instr(line, ",") + 1, F.length(line)), F.lit(SPACES))
    known = _first_held(low, KNOWN_LANGUAGES)
    technical = F.btrim(F.substring_index(low, ":", 1), F.lit(SPACES)).isin(*TECH_CATEGORY_HEADERS)
    return (
        F.when(technical, F.lit(None))
        .when(named(in_brackets), pair(in_brackets, F.regexp_extract(line, LANG_IN_BRACKETS, 2)))
        .when(F.contains(line, F.lit(",")) & named(before), pair(before, after))
        .when(known.isNotNull(), pair(F.initcap(known), F.coalesce(_first_held(low, LANG_PROFICIENCY), none)))
    )


def languages(text: Column) -> Column:
    """Spoken languages of a text, one a line at most: array of (language, proficiency)."""
    return F.filter(F.transform(_lines(text), _language), lambda x: x.isNotNull())


def leadership(items: Column) -> Column:
    """Items that are more than membership: array of strings; null has none."""
    bare = lambda x: F.ltrim(F.btrim(F.lower(x), F.lit(SPACES)), F.lit("-*•·–— "))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: ~bare(x).rlike("^(?:" + "|".join(MEMBER_STARTS) + ")"))


def merged(first: Column, second: Column, key=F.lower) -> Column:
    """Ordered union of two arrays; of entries with equal keys the first stays, entries without a key go."""
    both = F.filter(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))), lambda x: x != "")
    return _let(both, lambda b: _let(F.transform(b, key), lambda keys: F.filter(b, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def longer(rules: Column, learned: Column) -> Column:
    """The array with more entries; the learned one wins ties."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.when(n(learned) >= n(rules), learned).otherwise(rules)


def _institution(line: Column) -> Column:
    """An institution's name: no label, years, further columns, grades or edge punctuation."""
    name = F.regexp_replace(line, r"(?i)^(?:institution|school|college|university) ?:\s*", "")
    name = F.regexp_replace(F.regexp_replace(name, ANY_YEAR, ""), YEAR_SPAN, "")
    name = F.regexp_replace(F.substring_index(name, "|", 1), r"(?is)(?:c?gpa:|g\.p\.a|first class|second class|distinction|class).*$", "")
    return F.btrim(name, F.lit(",- |/" + SPACES))


def education(text: Column) -> Column:
    """Entries of a free education text: array of (degree, institution, year, gpa, field).

    Entries lie between blank lines or numbers; the first line that shows a value gives
    it.  Without a year of its own an entry takes the last of the text, without a grade
    the greatest.  Entries without degree and institution go; null and blank texts have
    none.  Institutions are found by keywords only, not by a model of names.
    """
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    years = F.regexp_extract_all(whole, F.lit(ANY_YEAR), 0)
    grades = F.transform(F.regexp_extract_all(whole, F.lit(GPA), 1), lambda g: g.cast("double"))
    common = F.struct(F.get(years, F.size(years) - 1).cast("int").alias("year"), F.array_max(grades).alias("gpa"))

    def entry(lines: Column, whole_text: Column) -> Column:
        first = lambda test: F.get(F.filter(lines, test), F.lit(0))
        degrees = "|".join(DEGREES).replace(".", r"\.")
        written = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(k)), F.lit(v)) for k, v in DEGREES.items()], F.lit(""))
        field = lambda x: F.initcap(F.coalesce(_first_held(x, FIELDS), F.lit("")))
        titled = F.lower(first(lambda x: F.lower(x).rlike(degrees)))
        degree = _let(titled, lambda x: F.struct(written(x).alias("degree"), field(x).alias("field")))
        place = F.coalesce(_institution(first(lambda x: F.lower(x).rlike("|".join(INSTITUTIONS)))), F.lit(""))
        own_year = lambda x: F.coalesce(F.regexp_extract(x, ANY_YEAR, 0).try_cast("int"), F.regexp_extract(x, YEAR_SPAN, 2).try_cast("int"))
        year = F.coalesce(_let(first(lambda x: x.rlike(ANY_YEAR + "|" + YEAR_SPAN)), own_year), whole_text["year"])
        gpa = F.coalesce(F.regexp_extract(first(lambda x: x.rlike(GPA)), GPA, 1).try_cast("double"), whole_text["gpa"])
        return _let(degree, lambda d: F.struct(d["degree"], place.alias("institution"), year.alias("year"), gpa.alias("gpa"), d["field"].alias("field")))

    parts = F.filter(F.split(whole, ENTRY_BREAK), lambda p: F.length(F.btrim(p, F.lit(SPACES))) >= 5)
    found = _let(common, lambda c: F.transform(parts, lambda p: _let(_lines(p), lambda lines: entry(lines, c))))
    return F.filter(found, lambda e: (e["degree"] != "") | (e["institution"] != ""))


def _is_title(line: Column) -> Column:
    """Whether a line looks like a project's title: short, no sentence, with a separator or a link beside text."""
    only_link = line.rlike(GITHUB) & (F.regexp_replace(line, r"\s*" + "github\\.com/[\\w-]+/[\\w-]+" + r"\s*", "") == "")
    return (F.length(line) <= 90) & ~F.endswith(line, F.lit(".")) & ~only_link & line.rlike(TITLE_SEPARATOR)


def projects(text: Column, skills: tuple[str, ...] = ()) -> Column:
    """Projects of a free text: array of (name, tools, description, link).

    A project starts with each block between blank lines and with each later line that
    looks like a title.  ``tools`` are the given skills whose words the project shows.
    Null and blank texts have none.
    """

    def project(lines: Column) -> Column:
        title = F.btrim(F.regexp_replace(lines[0], BULLET_START, ""), F.lit(SPACES))
        name = F.btrim(F.get(F.split(title, r"\s[-–]\s+"), F.lit(0)), F.lit(SPACES))
        rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), " ")
        shown = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.concat_ws(" ", title, rest)), F.lit(r"[a-z0-9+#]+(?:\.[a-z0-9+#]+)*"), 0), " "), F.lit(" "))
        tools = F.filter(F.array(*[F.lit(s) for s in skills]).cast("array<string>"), lambda s: F.contains(shown, F.concat(F.lit(" "), F.lower(s), F.lit(" "))))
        link = F.nullif(F.regexp_extract(F.array_join(lines, "\n"), GITHUB, 0), F.lit(""))
        return F.struct(name.alias("name"), tools.alias("tools"), rest.alias("description"), link.alias("link"))

    def groups(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | _is_title(x), i + 1)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(at, lambda s, k: F.slice(lines, s, F.coalesce(F.get(at, k + 1), F.size(lines) + 1) - s)))

    blocks = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), r"\n{2,}")
    return F.transform(F.flatten(F.transform(blocks, lambda b: _let(_lines(b), groups))), project)
