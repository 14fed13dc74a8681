"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); failing
lines are removed; a document that loses too much of its text is rejected, as is
one that fails the base rules on word count and repeated word windows.

- Punctuation: many words that end in doubled symbols, or a long line without a single
  punctuation mark.
- Navigation: labels between bars or bullets.
- Boilerplate: a short line that holds a fixed phrase of site notices; longer lines are
  prose that may mention it.

Defined results: a null or empty text has no words and fails the base rules
(``kept`` false, ``clean_text`` empty); repeated rows are judged each by itself;
an empty table gives an empty result; input columns named like an output column
are replaced, all others are passed through by :func:`judge`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, words

#: Base rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A document is rejected when more than this share of its characters is removed.
MAX_REMOVED_PERCENT = 50
#: Navigation: at least so many bars or bullets in a line, and one for every so many words.
MIN_SEPARATORS = 3
WORDS_PER_SEPARATOR = 4
#: Punctuation: at least so many words that end in doubled symbols, and one in so many words.
MIN_DECORATED = 3
DECORATED_ONE_IN = 5
#: Punctuation: a line of at least so many words has a mark somewhere.
MIN_UNMARKED = 20
#: Boilerplate: lines of more words than this are not judged by phrases.
MAX_NOTICE_WORDS = 40

SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|•»›]"
SEPARATED = r"(?:[|•»›][^|•»›]*){3}"
DOUBLED = r"!!|\?\?|[#*$%&]{2}"
DECORATED = r"[^\x20\x09-\x0D](?:!!|\?\?|[#*$%&]{2})[#*$%&!?]*(?:[\x20\x09-\x0D]|$)"
MARK = r"[.!?…,;:。！？、，；：]"
WORD = r"[^\x20\x09-\x0D]+"
#: A line without a mark that is long enough for ``MIN_UNMARKED`` words.
UNMARKED_LINE = r"(?:^|\n)[^\n.!?…,;:。！？、，；：]{39,}(?:\n|$)"
#: Phrases of lines that belong to a site and not to a text, in lower case.
BOILERPLATE_PHRASES = (
    "all rights reserved", "licensed under the", "under the mit license", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "uses cookies", "enable javascript", "lorem ipsum",
    "sign up for our newsletter", "subscribe to our newsletter", "share this article", "click here to",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales",
    "utilise des cookies", "abonnez-vous à notre newsletter", "cliquez ici pour", "partager cet article",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies",
    "abonnieren sie unseren newsletter", "klicken sie hier", "diesen artikel teilen",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso",
    "utiliza cookies", "suscríbete a nuestro boletín", "haz clic aquí", "compartir este artículo",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*COUNTS, "base_failed", "kept", "clean_text", "removed_chars")


def _holds_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def text_signs(text: Column) -> dict[str, Column]:
    """Whether some line of a text may fail each rule; the rules look at the lines only then."""
    return {
        "navigation": _holds_any(text, "|•»›"),
        "decorated": _holds_any(text, ("!!", "??", *"#*$%&")),
        "unmarked": text.rlike(UNMARKED_LINE),
        "boilerplate": _holds_any(F.lower(text), BOILERPLATE_PHRASES),
    }


def line_fails(line: Column, signs: dict[str, Column] | None = None) -> Column:
    """Whether a line fails the navigation, punctuation or boilerplate rule."""
    signs = signs or text_signs(line)
    n = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    decorated = F.regexp_count(line, F.lit(DECORATED))
    navigation = signs["navigation"] & line.rlike(SEPARATED) & (separators * F.lit(WORDS_PER_SEPARATOR) >= n)
    marks = signs["decorated"] & line.rlike(DOUBLED) & (decorated >= MIN_DECORATED) & (decorated * F.lit(DECORATED_ONE_IN) >= n)
    unmarked = signs["unmarked"] & ~line.rlike(MARK) & (n >= MIN_UNMARKED)
    boilerplate = signs["boilerplate"] & _holds_any(F.lower(line), BOILERPLATE_PHRASES) & (n <= MAX_NOTICE_WORDS)
    return navigation | marks | unmarked | boilerplate


def _judged(docs: DataFrame, text_col: str, stem: str) -> DataFrame:
    """The counts and verdicts, the other columns, and a row number named ``stem + "row"``.

    The row number stands beside the counts so that a filter on a verdict stays above
    them; moved below, it would build words and windows anew for every element.
    """
    own = lambda name: F.col(stem + name)
    passed = [c for c in docs.columns if c not in OUTPUTS]
    text, w = F.coalesce(F.col(text_col), F.lit("")), words(F.col(text_col))
    # All that takes no function over elements comes first, so that later projections carry little.
    rows = docs.select(
        *passed,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.length(text).cast("bigint").alias(stem + "chars"),
        F.split(text, "\n").alias(stem + "l"),
        w.alias(stem + "w"),
        text.alias(stem + "t"),
        *[c.alias(stem + k) for k, c in text_signs(text).items()],
    )
    signs = {k: own(k) for k in text_signs(text)}
    any_sign = reduce(lambda a, b: a | b, signs.values())
    lines = F.filter(own("l"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    done = [*passed, "n_words", "word_chars", "n_symbols"]
    rows = rows.select(
        *done,
        F.transform(own("w"), lambda w: F.xxhash64(w)).alias(stem + "wh"),
        F.when(any_sign, F.filter(own("l"), lambda x: ~line_fails(x, signs))).alias(stem + "keep"),
        F.when(F.size(own("l")) > F.size(F.array_distinct(own("l"))), lines).alias(stem + "wl"),
        (own("chars") - F.size(own("l")) + 1).alias(stem + "total"),
        own("t"),
    )
    # A window's hash is that of the hashes of its words, each of which is hashed once.
    starts = F.slice(own("wh"), F.lit(1), F.greatest(F.size(own("wh")) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(own("wh"), i + k) for k in range(1, WINDOW)]))
    done = [*done, "n_dup_lines", "clean_text", "removed_chars", stem + "total"]
    rows = rows.select(
        *done[:-4],
        windows.alias(stem + "h"),
        F.coalesce(F.size(own("wl")) - F.size(F.array_distinct(own("wl"))), F.lit(0)).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.array_join(own("keep"), "\n"), own("t")).alias("clean_text"),
        F.coalesce(own("total") - F.length(F.array_join(own("keep"), "")), F.lit(0)).cast("bigint").alias("removed_chars"),
        own("total"),
    )
    # Positions of windows that occur twice or more: neighbours in hash order are equal.
    pairs = F.sort_array(F.transform(own("h"), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    rows = rows.select(*done, F.when(F.size(own("h")) > F.size(F.array_distinct(own("h"))), pairs).alias(stem + "p"))
    beside = lambda k: F.get(own("p"), k)["h"]
    twice = F.filter(F.transform(own("p"), lambda x, k: F.when((beside(k - 1) == x["h"]) | (beside(k + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.select(*done, F.sort_array(twice).alias(stem + "at"))
    covered = F.aggregate(
        F.transform(own("at"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(own("at"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    rows = rows.select(*done, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), F.monotonically_increasing_id().alias(stem + "row"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("removed_chars") * 100 > own("total") * MAX_REMOVED_PERCENT
    return rows.select("*", failed.alias("base_failed"), (~failed & ~lost).alias("kept")).drop(stem + "total")


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts, ``clean_text``, ``removed_chars``, ``base_failed`` and ``kept``.

    Every step is a row-wise projection: no shuffle, nothing in Python.  Repeated
    word windows are found by hashing each window and, only where a document has
    equal hashes, by sorting (hash, position) pairs inside the row.
    """
    stem = fresh([*docs.columns, *OUTPUTS], "_q")
    return _judged(docs, text_col, stem).drop(stem + "row")


def keep_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, their failing lines removed; ``n_chars`` follows the text.

    Input columns stay, also those named like a count or verdict, which are not in the result.
    """
    held = [c for c in docs.columns if c in OUTPUTS]
    stem = fresh([*docs.columns, *OUTPUTS], "_q")
    rows = docs.select(*[F.col(c).alias(stem + "in_" + c) if c in held else F.col(c) for c in docs.columns])
    judged = _judged(rows, stem + "in_" + text_col if text_col in held else text_col, stem).where(F.col("kept") & (F.col(stem + "row") >= 0))
    out = {text_col: F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return judged.select(*[out.get(c, F.col(stem + "in_" + c if c in held else c)).alias(c) for c in docs.columns])
