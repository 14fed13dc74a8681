"""Format-preserving pseudonyms for personal data and secrets.

Detectors find candidates; validators (Luhn, mod 97, calendar, octet range, digit
count) decide; what is found is read as a number in the mixed radix of its own format
and permuted by a keyed Feistel network with cycle walking; values of many characters go
through a Feistel network on their two halves, in time linear in their length.  So a
pseudonym has its original's format and length, passes its validator, is the same wherever
the value occurs, and no two values of a format share one.

A date's format is its separator, the order of its fields and the width of day and month.
Within it, the dates of 1900 to 2099 are permuted among themselves, and so are those of
all other years from 1 to 9999.  Where day or month may come first, the format's values
are all strings that are a date in either order.

Defined results: a null text stays null with no findings; texts of any length are read
whole; repeated rows give repeated results; an empty table gives an empty result; input
columns named like an output column are replaced, all others stay.  Numbers below nine
digits, version numbers and impossible dates or addresses are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from calendar import isleap
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

ROUNDS = 8
#: Only for tests and examples: give your own key.
DEFAULT_KEY = b"quillion example key"
#: The alphabets within which a character stays.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
PLACE = {c: (a, a.index(c)) for a in ALPHABETS for c in a}
HEX = {c: ("0123456789abcdef", "0123456789abcdef".index(c)) for c in "0123456789abcdef"}
HEX_UPPER = {c: ("0123456789ABCDEF", "0123456789ABCDEF".index(c)) for c in "0123456789ABCDEF"}
#: Dates of these years stay among themselves.
MODERN = range(1900, 2100)
LAST_YEAR = 9999
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Longer values take the network of linear time.
LONG_VALUE = 64


class Permuter:
    """A keyed permutation of range(n) for any n and purpose."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.number = lru_cache(100_000)(self._number)

    def _round(self, purpose: bytes, k: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hashlib.blake2b(b"%s|%d|%x" % (purpose, k, half), key=self.key, digest_size=min(64, size)).digest()
        while len(digest) < size:
            digest += hashlib.blake2b(digest, key=self.key).digest()
        return int.from_bytes(digest[:size], "big") & ((1 << bits) - 1)

    def _number(self, purpose: bytes, value: int, n: int) -> int:
        if n < 2:
            return value
        bits = max(2, (n - 1).bit_length())
        purpose = b"%s|%x" % (purpose, n)
        while True:
            low = bits // 2
            widths = [low, bits - low]
            right, left = value & ((1 << low) - 1), value >> low
            for k in range(ROUNDS):  # the half of width widths[k % 2] drives the other
                if k % 2 == 0:
                    left ^= self._round(purpose, k, right, widths[1])
                else:
                    right ^= self._round(purpose, k, left, widths[0])
            value = left << low | right
            if value < n:
                return value

    def _stream(self, purpose: bytes, k: int, half: np.ndarray, size: int) -> np.ndarray:
        """Bytes that depend on a half of a value."""
        seed = hashlib.blake2b(b"%s|%d|%d|" % (purpose, k, size) + half.tobytes(), key=self.key).digest()
        return np.frombuffer(hashlib.shake_256(seed).digest(2 * size), "<u2")

    def digits(self, purpose: bytes, value: np.ndarray, radix: np.ndarray) -> np.ndarray:
        """Permute a value of any length, given as digits of their own radix each."""
        half = len(value) // 2
        parts, bases = [value[:half], value[half:]], [radix[:half], radix[half:]]
        for k in range(ROUNDS):
            new, old = k % 2, 1 - k % 2
            parts[new] = (parts[new] + self._stream(purpose, k, parts[old], len(parts[new]))) % bases[new]
        return np.concatenate(parts)

    def chars(self, purpose: bytes, text: str, places: dict = PLACE) -> str:
        """Permute the characters that have a place, each within its alphabet."""
        if len(text) > LONG_VALUE:
            return self._long(purpose, text, places)
        value, n, at = 0, 1, []
        for k, c in enumerate(text):
            if c in places:
                alphabet, digit = places[c]
                value, n = value * len(alphabet) + digit, n * len(alphabet)
                at.append((k, alphabet))
        shape = "".join(places[c][0][0] if c in places else c for c in text)
        value = self.number(purpose + b"|" + shape.encode("utf-8", "surrogatepass"), value, n)
        out = list(text)
        for k, alphabet in reversed(at):
            value, digit = divmod(value, len(alphabet))
            out[k] = alphabet[digit]
        return "".join(out)


    def _long(self, purpose: bytes, text: str, places: dict) -> str:
        at = [k for k, c in enumerate(text) if c in places]
        found = [places[text[k]] for k in at]
        value = np.array([d for _, d in found], np.int64)
        radix = np.array([len(a) for a, _ in found], np.int64)
        shape = "".join(places[c][0][0] if c in places else c for c in text)
        purpose = purpose + b"|" + hashlib.blake2b(shape.encode("utf-8", "surrogatepass")).digest()
        out = list(text)
        for k, (alphabet, _), d in zip(at, found, self.digits(purpose, value, radix).tolist()):
            out[k] = alphabet[d]
        return "".join(out)


def luhn_sum(digits: str) -> int:
    """Luhn sum with the last digit counted once."""
    double = [int(d) for d in digits[-2::-2]]
    return sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in double)


def _fill(template: str, digits: str) -> str:
    """Put digits into the digit places of a template."""
    new = iter(digits)
    return "".join(next(new) if c.isdecimal() else c for c in template)


def _email(p: Permuter, m: re.Match) -> str:
    name, _, tld = m[0].rpartition(".")
    return p.chars(b"email", name) + "." + tld


def _address(p: Permuter, m: re.Match) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = p.number(b"ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _card(p: Permuter, m: re.Match) -> str:
    digits = re.sub(r"\D", "", m[0])
    if len(digits) <= 19 and len(digits) >= 12 and luhn_sum(digits) % 10 == 0:
        body = p.chars(b"card", digits[:-1])
        return _fill(m[0], body + str(-luhn_sum(body + "0") % 10))
    return _fill(m[0], p.chars(b"number", digits))


def _phone(p: Permuter, m: re.Match) -> str | None:
    code, rest = m[1] or "", m[0][len(m[1] or "") :]
    if not 7 <= sum(c.isdecimal() for c in m[0]) <= 15:
        return None
    return code + _fill(rest, p.chars(b"phone", re.sub(r"\D", "", rest)))


def _ssn(p: Permuter, m: re.Match) -> str:
    return _fill(m[0], p.chars(b"ssn", m[0].replace("-", "")))


def _iban(p: Permuter, m: re.Match) -> str | None:
    def rest(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97

    text = m[0].replace(" ", "")
    if rest(text) != 1:
        return None
    body = text[:2] + "00" + p.chars(b"iban", text[4:])
    new = iter(f"{body[:2]}{98 - rest(body):02d}{body[4:]}")
    return "".join(" " if c == " " else next(new) for c in m[0])


class DateFormat:
    """All values of a format of dates: pairs of fields by year, in one row of numbers.

    ``widths`` are those of the two fields beside the year (1: no leading zero, so 1 to 9;
    2: two digits).  ``either``: a pair counts if it is a day and month in either order;
    else the first is the month.
    """

    def __init__(self, widths: tuple[int, int], either: bool):
        self.pairs: dict[bool, list[tuple[int, int]]] = {}
        self.rank: dict[bool, dict[tuple[int, int], int]] = {}
        fields = [range(1, 10) if w == 1 else range(1, 32) for w in widths]
        for leap in (False, True):
            days = [29 if leap and m == 2 else d for m, d in enumerate(MONTH_DAYS, 1)]
            fits = lambda month, day, days=days: 1 <= month <= 12 and day <= days[month - 1]
            self.pairs[leap] = [(a, b) for a in fields[0] for b in fields[1] if fits(a, b) or (either and fits(b, a))]
            self.rank[leap] = {pair: k for k, pair in enumerate(self.pairs[leap])}
        sizes = lambda years: [len(self.pairs[isleap(y)]) for y in years]
        others = [y for y in range(1, LAST_YEAR + 1) if y not in MODERN]
        self.eras = [(years, [0, *accumulate(sizes(years))]) for years in (list(MODERN), others)]

    def permuted(self, p: Permuter, purpose: bytes, year: int, a: int, b: int) -> tuple[int, int, int] | None:
        """Another value of the format, or None if this is none."""
        rank = self.rank[isleap(year)].get((a, b)) if year else None
        if rank is None:
            return None
        era = 0 if year in MODERN else 1
        years, offsets = self.eras[era]
        at = year - MODERN[0] if era == 0 else year - 1 - (len(MODERN) if year > MODERN[-1] else 0)
        new = p.number(b"%s|%d" % (purpose, era), offsets[at] + rank, offsets[-1])
        at = bisect_right(offsets, new) - 1
        return years[at], *self.pairs[isleap(years[at])][new - offsets[at]]


@lru_cache(None)
def date_format(first: int, second: int, either: bool) -> DateFormat:
    return DateFormat((first, second), either)


def _iso_date(p: Permuter, m: re.Match) -> str | None:
    year, mark, month, day = m.groups()
    new = date_format(len(month), len(day), False).permuted(p, f"iso{mark}{len(month)}{len(day)}".encode(), int(year), int(month), int(day))
    return new and f"{new[0]:04d}{mark}{new[1]:0{len(month)}d}{mark}{new[2]:0{len(day)}d}"


def _local_date(p: Permuter, m: re.Match) -> str | None:
    a, mark, b, year = m.groups()
    new = date_format(len(a), len(b), True).permuted(p, f"local{mark}{len(a)}{len(b)}".encode(), int(year), int(a), int(b))
    return new and f"{new[1]:0{len(a)}d}{mark}{new[2]:0{len(b)}d}{mark}{new[0]:04d}"


def _secret(p: Permuter, m: re.Match) -> str:
    head, body = m[1] or "", m[0][len(m[1] or "") :]
    places = HEX if re.fullmatch("[0-9a-f]+", body) else HEX_UPPER if re.fullmatch("[0-9A-F]+", body) else PLACE
    return head + p.chars(b"secret", body, places)


def _assigned(p: Permuter, m: re.Match) -> str:
    body = m[0][len(m[1]) :]
    places = HEX if re.fullmatch("[0-9a-f]+", body) else PLACE
    return m[1] + p.chars(b"secret", body, places)


#: Kind, pattern, pseudonym (None: not valid); earlier kinds win where findings overlap.
DETECTORS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(r"(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), _email),
    ("secret", re.compile(r"(?<![\w])((?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)?)(?:(?<=AKIA)[0-9A-Z]{16}|(?<=ASIA)[0-9A-Z]{16}|(?<=_)[A-Za-z0-9]{36,}|(?<=-)[A-Za-z0-9-]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w])"), _secret),
    ("secret", re.compile(r"((?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?)[^\s\"'<>,;]{8,}"), _assigned),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("date", re.compile(r"(?<![\w./-])([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![\w/-]|\.\d)"), _iso_date),
    ("date", re.compile(r"(?<![\w./-])([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})(?![\w/-]|\.\d)"), _local_date),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _address),
    ("phone", re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])()(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"), _phone),
    ("card", re.compile(r"(?<![\w.-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\w)|(?<![\w.-])\d{4}([ -])\d{6}\2\d{4,5}(?!\w)"), _card),
    ("number", re.compile(r"(?<![\w.-])\d{9,}(?![\w-]|\.\d)"), _card),
)
HINT = re.compile(r"[\d@]")
SECRET_WORDS = ("passw", "secret", "token", "key")


def may_hold_any(text: str) -> bool:
    """Whether any detector can find something."""
    if HINT.search(text):
        return True
    lowered = text.lower()
    return any(word in lowered for word in SECRET_WORDS)


def pseudonymise(text: str | None, permuter: Permuter) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the kind, start and length of each finding in the original."""
    if not text or not may_hold_any(text):
        return text, []
    found = []
    for order, (kind, pattern, make) in enumerate(DETECTORS):
        for m in pattern.finditer(text):
            if (new := make(permuter, m)) is not None:
                found.append((order, m.start(), m.end(), kind, new))
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text)) if found else b""
    for _, a, b, kind, new in sorted(found):
        if not any(used[a:b]):
            used[a:b] = b"\x01" * (b - a)
            taken.append((a, b, kind, new))
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b - a) for a, b, kind, _ in taken]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
_PERMUTERS: dict[bytes, Permuter] = {}


def _replace(batches: Iterator[pa.RecordBatch], key: bytes, text_col: str, keep: list[str], spans: bool) -> Iterator[pa.RecordBatch]:
    permuter = _PERMUTERS.setdefault(key, Permuter(key))
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        done = [pseudonymise(t, permuter) for t in column(text_col).to_pylist()]
        arrays = [pa.array([t for t, _ in done], pa.string()) if c == text_col else column(c) for c in keep]
        if spans:
            arrays.append(pa.array([[dict(zip(("kind", "start", "length"), s)) for s in x] for _, x in done], _SPANS))
        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *["pii"] * spans])


def pseudonymise_texts(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text", spans: bool = True) -> DataFrame:
    """Replace personal data in the text; ``pii`` lists kind, start and length in the original."""
    keep = [f for f in docs.schema.fields if not (spans and f.name == "pii")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *([T.StructField("pii", SPANS)] if spans else [])])
    return docs.select(*names).mapInArrow(lambda b: tidy(_replace(b, key, text_col, names, spans)), schema)
