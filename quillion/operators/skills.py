"""Skills: phrases of a taxonomy in a text, expansion of chained entries, fusion with tagged spans.

The taxonomy is a parameter; tokens are those of lexical scores, stop words kept.
Null texts and arrays have no skills.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, ngrams
from .entities import merged

NONE = "array<string>"
#: What separates the skills of a chained entry.
SEPARATOR = r"\s*(?:,|、|/|&|\||\band\b|\bor\b)\s*"
#: Addresses, links and numbers, which are no skills, and places.
NOISE = r"(?i)https?://|www\.|\S@\S|\.(?:com|org|net|io)\b|\+?\d[\d\s().-]{6,}"
PLACES = ("india", "usa", "bangladesh", "dhaka", "london", "new york", "remote")
EDGE = " .,;:!?()'\""


def read_taxonomy(spark: SparkSession, path: str) -> list[str]:
    """The skills of a JSON file ``{"categories": {name: [skill, ...]}}``, in order, each once (a bounded file)."""
    text = spark.read.text(path, wholetext=True).first()
    groups = json.loads(text[0])["categories"].values() if text else ()
    return list(dict.fromkeys(s for group in groups for s in group))


def written(taxonomy: Sequence[str]) -> dict[str, str]:
    """Each skill in lower case by its tokens."""
    return {" ".join(re.findall(TOKEN, s.lower())): s.lower() for s in taxonomy if re.findall(TOKEN, s.lower())}


def extract_skills(text: Column, taxonomy: Sequence[str]) -> Column:
    """The taxonomy's skills whose tokens come one after the other in a text, in order of the alphabet."""
    names = written(taxonomy)
    if not names:
        return F.array().cast(NONE)
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    longest = max(len(k.split()) for k in names)
    found = F.array_intersect(F.array(*map(F.lit, names)), ngrams(words, longest))
    other = {k: v for k, v in names.items() if k != v}
    if other:
        table = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
        found = F.transform(found, lambda s: F.coalesce(F.try_element_at(table, s), s))
    return F.array_sort(found)


def expand(skills: Column) -> Column:
    """Each entry, and the parts of chained ones; in lower case, each once."""
    bare = lambda s: F.btrim(F.lower(F.btrim(s)), F.lit("."))
    each = F.filter(F.transform(F.coalesce(skills, F.array().cast(NONE)), bare), lambda s: s != "")
    parts = F.transform(each, lambda s: F.transform(F.split(s, SEPARATOR), lambda p: F.btrim(F.btrim(p, F.lit(".")))))
    return F.array_distinct(F.filter(F.concat(each, F.flatten(parts)), lambda s: s != ""))


def span_parts(span: Column) -> Column:
    """The skills of a tagged span, which may be a chain of several; none where it is an address or a place."""
    whole = F.btrim(span, F.lit(EDGE))
    place = lambda s: F.lower(s).isin(*PLACES)
    parts = F.transform(F.split(whole, r"\s*[,;/|•]\s*"), lambda p: F.btrim(p, F.lit(EDGE)))
    kept = F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.rlike(NOISE) & ~place(p))
    return F.when((F.length(whole) >= 2) & ~whole.rlike(NOISE), kept).otherwise(F.array().cast(NONE))


def merge_spans(skills: Column, spans: Column) -> Column:
    """Ordered union of known skills and the parts of tagged spans, without regard to case."""
    return merged(skills, F.flatten(F.transform(F.coalesce(spans, F.array().cast(NONE)), span_parts)))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text contains one of some terms."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))
