"""Work experience from free text: date ranges as anchors, what stands before and after them as roles.

The text is split at its date ranges; no step looks at another role than its neighbours,
and everything stays in expressions.  Null and blank texts have no roles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import SPACES, _let, _lines
from .skills import any_term

#: Months, open ends, and the four forms of a date range.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMES = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_MONTH = rf"(?:{_NAMES})[a-z]*[.,]?\s+"
_OPEN = "Present|Current|Till Date"
_TO = r"\s*[-–to]+\s*"
RANGE = (
    rf"(?i)(?:{_MONTH}\d{{4}}{_TO}(?:{_MONTH})?(?:\d{{4}}|{_OPEN})"
    rf"|\d{{1,2}}/\d{{4}}{_TO}(?:\d{{1,2}})?/?(?:\d{{4}}|{_OPEN})"
    rf"|\d{{4}}-\d{{2}}{_TO}\d{{4}}-\d{{2}}"
    rf"|\d{{4}}{_TO}(?:\d{{4}}|{_OPEN}))"
)
#: A date and, with no year between, an open end or a year: for ranges that other text parts.
LOOSE_RANGE = rf"(?i)(?:{_MONTH})?\d{{4}}(?:(?!\b20\d{{2}}\b)[\s\S])*?(?:\bPresent\b|\bCurrent\b|\bTill\s+Date\b|\b20\d{{2}}\b)"
#: Seasons, which count as three months.
SEASON = r"(?i)\b(?:Spring|Summer|Fall|Autumn|Winter)\s+\d{4}\b"
SEASON_STARTS = {"spring": "Mar", "summer": "Jun", "fall": "Sep", "autumn": "Sep", "winter": "Dec"}
SEASON_ENDS = {"spring": "Jun", "summer": "Sep", "fall": "Dec", "autumn": "Dec", "winter": "Mar"}
#: Last words of companies, words of job titles, places.
COMPANY_SUFFIXES = (
    "corp", "corporation", "inc", "incorporated", "ltd", "limited",
    "llc", "llp", "pvt", "private", "technologies", "consulting",
    "services", "solutions", "group", "systems", "industries", "labs",
)
JOB_TITLE_WORDS = (
    "engineer", "developer", "manager", "analyst", "scientist",
    "architect", "designer", "lead", "head", "director", "officer",
    "specialist", "consultant", "coordinator", "administrator",
    "intern", "trainee", "associate", "executive",
)
PLACES = (
    "bangalore", "bengaluru", "mumbai", "delhi", "pune", "kolkata",
    "chennai", "hyderabad", "ahmedabad", "india", "nagpur",
    "new york", "san francisco", "oakland", "remote",
    "mountain view", "chicago", "usa", "portland", "seattle",
)
_EDGE = ",\n\t "


def is_open(mark: Column) -> Column:
    return F.lower(F.btrim(mark)).isin("present", "current", "till date", "now", "")


def month_number(mark: Column, now_month: int) -> Column:
    """Months since year 0 of ``Mon YYYY``, ``YYYY-MM``, ``MM/YYYY`` or ``YYYY``; null if it is none.

    A mark without a month takes the month of now, as published.
    """
    name = F.lower(F.regexp_extract(mark, rf"(?i)\b({_NAMES})[a-z]*[.,]?\s+\d{{4}}", 1))
    year = F.regexp_extract(mark, r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int")
    digits = F.coalesce(
        F.nullif(F.regexp_extract(mark, r"(?<!\d)\d{4}-(\d{1,2})(?!\d)", 1), F.lit("")), F.nullif(F.regexp_extract(mark, r"(?<!\d)(\d{1,2})/\d{4}", 1), F.lit(""))
    ).try_cast("int")
    named = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    month = F.when(named > 0, named).when(digits.between(1, 12), digits).otherwise(F.lit(now_month))
    return year * 12 + month


def months_between(start: Column, end: Column, now: tuple[int, int]) -> Column:
    """Whole months from one mark to another, never negative; an open end is ``now`` (year, month)."""
    last = F.when(is_open(F.coalesce(end, F.lit(""))), F.lit(now[0] * 12 + now[1])).otherwise(month_number(end, now[1]))
    return F.coalesce(F.greatest(F.lit(0), last - month_number(start, now[1])), F.lit(0))


def is_company(text: Column) -> Column:
    low = F.lower(F.btrim(text, F.lit(SPACES)))
    last = F.btrim(F.element_at(F.split(low, r"\s+"), -1), F.lit("., "))
    return (low != "") & (last.isin(*COMPANY_SUFFIXES) | any_term(low, PLACES))


def is_job_title(text: Column) -> Column:
    words = F.split(F.lower(F.btrim(text, F.lit(SPACES))), r"\s+")
    return F.arrays_overlap(words, F.array(*map(F.lit, JOB_TITLE_WORDS)))


def clean_company(text: Column) -> Column:
    """A company's name without what follows a bar or a place."""
    edge = F.lit(" .,;/-|")
    name = F.btrim(F.substring_index(F.btrim(text, F.lit(SPACES)), "|", 1), edge)

    def cut(name: Column) -> Column:
        at = lambda place: F.instr(F.lower(name), place)
        cuts = [F.when(at(p) > 1, F.btrim(F.substr(name, F.lit(1), at(p) - 1), edge)) for p in sorted(PLACES, key=len, reverse=True)]
        return F.coalesce(*cuts, name)

    return _let(F.btrim(name, F.lit(SPACES + " .,;/-|")), cut)


def title_company(line: Column) -> Column:
    """(title, company) of a line: apart by a comma or bar, else by "at" or a dash, else all title."""

    def parts(lead: Column) -> Column:
        pair = lambda p: (F.btrim(F.regexp_extract(lead, p, 1)), F.btrim(F.regexp_extract(lead, p, 2)))
        a, b = pair(r"^(.*?)\s*[,|]\s*(.*)$")
        c, d = pair(r"(?i)^(.*?)\s+(?:at|@|–|—|-)\s+(.*)$")
        struct = lambda x, y: F.struct(x.alias("title"), y.alias("company"))
        return F.when((a != "") & (b != ""), struct(a, b)).when(d != "", struct(c, d)).otherwise(struct(lead, F.lit("")))

    return _let(F.btrim(F.btrim(F.coalesce(line, F.lit("")), F.lit(SPACES)), F.lit(".,:;")), parts)


def date_ranges(text: Column) -> Column:
    """Date ranges of a text in order, and the pieces around them: struct(ranges, pieces).

    Ranges in one of the four forms; without any, a date with a later open end or year;
    without any, seasons.
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda p: F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("ranges"), F.split(text, p).alias("pieces"))
    strict, loose = found(RANGE), found(LOOSE_RANGE)
    return F.when(F.size(strict["ranges"]) > 0, strict).when(F.size(loose["ranges"]) > 0, loose).otherwise(found(SEASON))


def range_marks(text: Column) -> Column:
    """(start, end) of a date range: ``Mon YYYY``, ``YYYY-MM`` or ``YYYY``; ends also Present."""
    get = lambda p, k=1: F.regexp_extract(text, p, k)
    table = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    season, year = F.lower(get(r"(?i)^(spring|summer|fall|autumn|winter)\b")), get(r"(\d{4})$")
    named = F.concat(get(rf"(?i)^({_NAMES})[a-z]*[.,]?\s+\d{{4}}"), F.lit(" "), get(rf"(?i)^(?:{_NAMES})[a-z]*[.,]?\s+(\d{{4}})"))
    numeric = F.concat(get(r"^\d{1,2}/(\d{4})"), F.lit("-"), get(r"^(\d{1,2})/\d{4}"))
    start = (
        F.when(season != "", F.concat(F.element_at(table(SEASON_STARTS), season), F.lit(" "), year))
        .when(F.btrim(named) != "", named).when(numeric != "-", numeric)
        .otherwise(F.coalesce(F.nullif(get(r"^(\d{4}-\d{2})(?!\d)"), F.lit("")), get(r"^(\d{4})")))
    )
    last = get(rf"(?i)(\d{{4}}|{_OPEN.replace(' ', chr(92) + 's+')})$")
    month = get(r"(\d{1,2})/\d{4}$")
    end = (
        F.when(season != "", F.concat(F.element_at(table(SEASON_ENDS), season), F.lit(" "), F.when(season == "winter", (year.try_cast("int") + 1).cast("string")).otherwise(year)))
        .when(get(r"(\d{4}-\d{2})$") != "", get(r"(\d{4}-\d{2})$")).when(last.rlike(r"^\D"), "Present")
        .when((numeric != "-") & (month != ""), F.concat(last, F.lit("-"), month)).otherwise(last)
    )
    return F.struct(start.alias("start"), end.alias("end"))


def _header_inside(text: Column) -> Column:
    """What stands between the dates of a loose range."""
    out = F.regexp_replace(text, rf"(?i)^\s*(?:(?:{_MONTH})?\d{{4}}|\d{{1,2}}/\d{{4}})\s*(?:[-–to]+\s*)?", "")
    out = F.regexp_replace(out, r"(?i)\s*(?:Present|Current|Till\s+Date|(?:19|20)\d{2})\s*$", "")
    return F.btrim(out, F.lit("-–—|,;:. \n\t"))


def _role(text: Column, match: Column, before: Column, after: Column, now: tuple[int, int]) -> Column:
    rstrip = lambda c: F.rtrim(c, F.lit(" ,;/-"))

    def role(lines: Column) -> Column:
        n = F.size(lines)
        last, above = F.coalesce(F.get(lines, n - 1), F.lit("")), F.coalesce(F.get(lines, n - 2), F.lit(""))
        own = F.when(n == 0, title_company(_header_inside(match))).otherwise(title_company(last))
        titles = F.transform(F.reverse(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0)))), lambda x: title_company(x)["title"])
        earlier = F.get(F.filter(titles, lambda t: (t != "") & is_job_title(t)), F.lit(0))
        marks, rest = range_marks(match), _lines(F.btrim(after, F.lit(_EDGE)))

        def done(x: Column) -> Column:
            back = (n > 1) & x["earlier"].isNotNull() & (is_company(x["own"]["title"]) | is_job_title(title_company(above)["title"]))
            company = clean_company(F.when(back, rstrip(last)).otherwise(rstrip(x["own"]["company"])))
            return _let(F.struct(back.alias("back"), company.alias("company")), lambda y: told(x, y["back"], y["company"]))

        def told(x: Column, back: Column, company: Column) -> Column:
            title = F.btrim(F.btrim(F.when(back, x["earlier"]).otherwise(x["own"]["title"]), F.lit(SPACES)), F.lit("-–—|,;:. "))
            next_line = F.coalesce(F.get(x["rest"], F.lit(0)), F.lit(""))
            found_next = (company == "") & is_company(next_line)
            kept = F.when(found_next, F.slice(x["rest"], F.lit(2), F.greatest(F.size(x["rest"]) - 1, F.lit(0)))).otherwise(x["rest"])
            other = F.array_join(F.filter(_lines(text), lambda y: y != F.btrim(before, F.lit(SPACES + ","))), " ")
            description = F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(other)
            return F.struct(
                title.alias("title"), F.when(found_next, clean_company(next_line)).otherwise(company).alias("company"), x["marks"]["start"].alias("start"),
                x["marks"]["end"].alias("end"), months_between(x["marks"]["start"], x["marks"]["end"], now).alias("duration_months"), description.alias("description"),
            )

        parts = F.struct(own.alias("own"), earlier.alias("earlier"), marks.alias("marks"), rest.alias("rest"))
        return F.when(~last.rlike(r"^(?:[-*•]|o )"), _let(parts, done))

    return _let(_lines(F.btrim(before, F.lit(_EDGE))), role)


def experience(text: Column, now: tuple[int, int]) -> Column:
    """Roles of a free text: array of (title, company, start, end, duration_months, description).

    A range inside a bullet is no role; of roles with one start the first stays; a loose
    range needs an end after its start.  ``now`` is (year, month).
    """

    def roles(found: Column) -> Column:
        each = F.transform(found["ranges"], lambda m, i: _role(text, m, F.get(found["pieces"], i), F.coalesce(F.get(found["pieces"], i + 1), F.lit("")), now))
        return F.filter(each, lambda r: r.isNotNull() & (is_open(r["end"]) | (F.coalesce(month_number(r["end"], now[1]) >= month_number(r["start"], now[1]), F.lit(False)))))

    def first_of_start(each: Column) -> Column:
        return _let(F.transform(each, lambda r: r["start"]), lambda starts: F.filter(each, lambda r, i: F.array_position(starts, r["start"]) == i + 1))

    return _let(_let(date_ranges(text), roles), first_of_start)


def years(roles: Column) -> Column:
    """Years of all roles, to one decimal (half to even)."""
    return F.bround(F.aggregate(F.transform(roles, lambda r: r["duration_months"]), F.lit(0), lambda a, m: a + m) / F.lit(12.0), 1)
