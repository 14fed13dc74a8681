"""The name of a person, from the first lines of a profile.

A line is a name if it has two or three words, shows capitals and none of the signs of
something else.  Known first names and technical terms are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import _let, _lines
from .experience import JOB_TITLE_WORDS
from .skills import any_term

#: Titles before a name, last words of companies, places, ends and words of technical terms.
SALUTATIONS = ("mr", "ms", "mrs", "dr", "prof")
COMPANY_ENDS = (
    "ltd", "limited", "inc", "corp", "corporation", "pvt", "private",
    "technologies", "consulting", "services", "solutions", "group",
    "systems", "industries", "labs", "llc",
)
PLACES = (
    "pradesh", "bangalore", "mumbai", "delhi", "pune", "kolkata",
    "chennai", "hyderabad", "ahmedabad", "india", "nagpur", "jabalpur",
    "maharashtra", "gujarat", "karnataka", "rajasthan", "punjab",
    "haryana", "kerala", "bihar", "assam", "odisha",
    "bangladesh", "dhaka", "chittagong", "chattogram", "rajshahi",
    "khulna", "sylhet", "barisal", "rangpur", "mymensingh",
    "usa", "america", "california", "texas", "florida",
    "washington", "boston", "austin", "seattle", "chicago",
)
SCHOOLS = ("college", "university", "school", "institute")
TECH_ENDS = (
    "ware", "base", "view", "logic", "query", "stream",
    "script", "scale", "score", "sense", "scope", "signal",
    "track", "trace", "trade", "train", "trait", "value",
    "cache", "cloud", "craft", "crud", "cycle", "debug",
    "drive", "event", "field", "flash", "frame", "graph",
    "guide", "layer", "light", "macro", "media", "metal",
    "micro", "model", "parse", "pixel", "print", "proof",
    "proto", "proxy", "pulse", "relay", "sight", "slash",
    "smart", "sniff", "space", "speed", "swarm", "sweet",
    "table", "touch", "tower", "tuner", "ultra", "union",
    "usage", "vault", "verse", "visor", "vista", "vital",
    "voice", "water", "weave", "whale", "wheel", "width",
)
PLAIN_WORDS = (
    "spring", "boot", "problem", "solving", "login", "registration",
    "restful", "secret", "key", "data", "routing", "protocol",
    "machine", "learning", "cloud", "foundry", "project", "management",
    "critical", "thinking", "teamwork", "communication", "leadership",
    "time", "analytical", "technical", "software", "hardware",
    "frontend", "backend", "fullstack", "signal", "digital",
    "network", "system", "science", "engineering", "service",
    "solution", "development", "application", "design", "quality",
    "control", "support", "planning", "strategy", "operation",
    "api", "scientist", "engineer", "developer", "manager",
    "analyst", "architect", "director", "officer", "specialist",
)
_MARKS = ".,;:!?-'\""


def _lits(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def is_tech_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text, or some words of it in a row, are one of the terms."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.btrim(text)), r"\s+", " "), F.lit(" "))
    return any_term(words, [f" {t.lower()} " for t in terms])


def looks_real(text: Column, first_names: Sequence[str] = ()) -> Column:
    """Whether words look like a person's name."""

    def test(words: Column) -> Column:
        bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(_MARKS)))
        lowered = lambda w: w.rlike(r"^\p{Ll}")
        good = F.forall(words, lambda w: ~lowered(w) & ~w.rlike(r"\d") & ~F.btrim(w, F.lit(".")).rlike(r"^\p{L}$"))
        technical = F.exists(bare, lambda w: w.rlike(f"(?:{'|'.join(TECH_ENDS)})$"))
        plain = (F.size(words) == 2) & F.forall(bare, lambda w: w.isin(*PLAIN_WORDS))
        known = F.arrays_overlap(bare, _lits([n.lower() for n in first_names])) if first_names else F.lit(False)
        return (F.size(words) > 0) & (known | (good & ~technical & ~plain))

    return _let(F.filter(F.split(F.btrim(text), r"\s+"), lambda w: w != ""), test)


def name_from_text(text: Column, tech_terms: Sequence[str] = (), first_names: Sequence[str] = ()) -> Column:
    """The first of the first ten lines that is a name; one after a title goes first; empty if none."""

    def words(x: Column) -> Column:
        return F.split(F.lower(x), r"\s+")

    def is_name(x: Column) -> Column:
        def test(w: Column) -> Column:
            other = x.rlike(r'^[{\[]|["|@]|\d') | any_term(F.lower(x), ("www.", "company", "title"))
            named = F.arrays_overlap(w, _lits((*JOB_TITLE_WORDS, *SCHOOLS, *PLACES))) | F.element_at(w, -1).isin(*COMPANY_ENDS)
            tech = is_tech_term(x, tech_terms) | F.arrays_overlap(F.transform(w, lambda y: F.btrim(y, F.lit(_MARKS))), _lits([t.lower() for t in tech_terms]))
            return F.size(w).isin(2, 3) & ~other & ~named & (F.regexp_count(x, F.lit(r"\p{Lu}")) >= 2) & ~tech & looks_real(x, first_names)

        return _let(words(x), test)

    def titled(x: Column) -> Column:
        return F.btrim(F.regexp_replace(x, r"^\S+\s*", ""))

    def greeted(lines: Column) -> Column:
        first = F.get(F.filter(F.slice(lines, 1, 5), lambda x: F.get(words(x), F.lit(0)).isin(*SALUTATIONS)), F.lit(0))
        return _let(titled(first), lambda after: F.when(F.size(words(after)).isin(2, 3) & ~is_tech_term(after, tech_terms), after))

    def pick(lines: Column) -> Column:
        known = lambda name: F.exists(F.slice(lines, 1, 10), lambda x: (x == name) & is_name(x))
        first = F.get(F.filter(F.slice(lines, 1, 10), is_name), F.lit(0))
        return _let(greeted(lines), lambda name: F.coalesce(F.when(~F.coalesce(known(name), F.lit(False)), name), first, F.lit("")))

    return _let(_lines(text), pick)
