"""Profiles made from keys alone, the same every time: free text, or sections that hold data.

Every value is a function of the key, so the truth about a profile can be stated without
reading its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ("Alice", "Daniel", "Maria", "Omar", "Priya", "Victor", "Helena")
LAST = ("Hartmann", "Okafor", "Lindqvist", "Moreau", "Castillo")
TITLES = ("Software Engineer", "Data Analyst", "Project Manager", "Research Scientist")
COMPANIES = ("Acme Labs", "Borealis Systems", "Cobalt Group")
SKILLS = ("python", "sql", "docker", "apache spark", "kubernetes", "c++", "node.js", "machine learning", "go", "tableau", "linux")
DEGREES = (("Bachelor of Science in Physics", "Bachelor", "Physics"), ("Master of Arts in Mathematics", "Master", "Mathematics"), ("PhD in Chemical Physics", "PhD", "Chemical"))
SCHOOLS = ("Northfield University", "Granite College")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CERTIFICATE = "AWS Certified Developer"
TONGUES = (("English", "Native"), ("Bengali", "Fluent"), ("French", "B2"))


def _of(values: tuple, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(index, F.lit(len(values))).cast("int"))


def _lines(n: Column, line) -> Column:
    """A line for each number from 0 to n - 1."""
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0))), lambda i: i < n)
    return F.array_join(F.transform(numbers, line), "\n")


def person(key: Column) -> Column:
    return F.concat(_of(FIRST, key), F.lit(" "), _of(LAST, F.floor(key / 7)))


def n_roles(key: Column) -> Column:
    return key % 4


def n_skills(key: Column) -> Column:
    return key % 11 + 1


def text(key: Column) -> Column:
    """A profile in eight sections; the last is empty for some keys."""
    degree, i = lambda k: _of(tuple(d[k] for d in DEGREES), key), F.lit
    start = lambda j: F.concat(_of(MONTHS, key + j * 5), i(" "), (2000 + 4 * j + key % 3).cast("string"))
    role = lambda j: F.concat(
        _of(TITLES, key + j), i(", "), _of(COMPANIES, key + j), i("\n"), start(j), i(" - "), _of(MONTHS, key + j * 7), i(" "), (2002 + 4 * j + key % 3).cast("string"), i("\n- Did things that mattered")
    )
    year = (2010 + key % 9).cast("string")
    parts = [
        person(key), F.concat(i("person"), key.cast("string"), i("@mail.example.com")), F.concat(i("Phone 555-"), F.lpad((key % 1000).cast("string"), 3, "0"), i("-4321")),
        i("Professional Summary"), i("Curious and calm."),
        i("Work Experience"), _lines(n_roles(key), role),
        i("Education"), F.concat(degree(0), i("\n"), _of(SCHOOLS, key), i(" | "), year, i("\nGPA: 3."), (key % 10).cast("string")),
        i("Skills"), _lines(n_skills(key), lambda j: _of(SKILLS, j)),
        i("Certifications"), _lines(key % 3, lambda j: F.concat(i(f"{CERTIFICATE} level "), j.cast("string"), i(" "), year)),
        i("Languages"), _lines(key % 4, lambda j: F.concat(_of(tuple(a for a, _ in TONGUES), j), i(" ("), _of(tuple(b for _, b in TONGUES), j), i(")"))),
        i("Leadership"), F.when(key % 2 == 0, "President of the chess club\nMember of the choir").otherwise(""),
    ]
    return F.array_join(F.array(*parts), "\n")


def sections(key: Column) -> Column:
    """A map of sections that hold data: JSON, a literal of Python, a list of JSON texts, objects in a row."""
    s = lambda c: c.cast("string")
    i = F.lit
    year = s(2010 + key % 9)
    role = lambda j: F.concat(
        i('{"title": "'), _of(TITLES, key + j), i('", "company": {"name": "'), _of(COMPANIES, key + j), i('"}, "dates": {"start": "'), s(2000 + 4 * j), i('-03", "end": "'), s(2001 + 4 * j),
        i('-05"}, "responsibilities": ["Built it", "Ran it"], "technical_environment": {"tools": ["git"]}}'),
    )
    numbers = lambda n: F.filter(F.sequence(i(0), F.greatest(n.cast("int"), i(0))), lambda j: j < n)
    roles = F.concat(i("['"), F.array_join(F.transform(numbers(n_roles(key)), role), "', '"), i("']"))
    return F.create_map(
        i("personal_info"), F.concat(i('{"name": "'), person(key), i('", "summary": "Likes Docker and SQL."}')),
        i("experience"), F.when(n_roles(key) == 0, "[]").otherwise(roles),
        i("education"), F.concat(i("{'degree': {'level': 'BSc', 'field': 'Physics'}, 'institution': {'name': '"), _of(SCHOOLS, key), i("'}, 'dates': {'end': '"), year, i("-06'}, 'achievements': {'gpa': 3."), s(key % 10), i("}}")),
        i("skills"), F.concat(i('{"technical": {"tools": [{"name": "Git"}, "Linux"]}, "languages": [{"name": "Go"}]}')),
        i("certifications"), F.concat(i('[{"name": "'), i(CERTIFICATE), i('", "issuer": {"name": "AWS"}, "date": "May '), year, i('"}, {"name": "unknown"}]')),
        i("languages"), i("[{'name': 'English', 'level': 'C1'}, 'Thai']"),
        i("projects"), i('[{"name": "Shop", "technologies": ["react", "unknown"], "role": "Lead", "description": "Sells.", "url": "github.com/a/shop"}]'),
        i("leadership"), i('["Member of a club", "Captain of a team"]'),
    )


def profiles(rows: DataFrame, key_col: str) -> DataFrame:
    """key, text and data of each row's profile."""
    key = F.col(key_col).cast("bigint")
    return rows.select(key.alias("key"), text(key).alias("text"), sections(key).alias("data"))
