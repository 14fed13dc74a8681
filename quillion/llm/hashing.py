"""Word hashes of many texts at once, by array arithmetic.

A word's hash is a polynomial in its characters' random values, read off two prefix
sums modulo 2^64 and moved to exponent zero by the inverse power; then mixed.  Texts are
taken in passes of bounded size, cut between words, so a text of any length costs the
working arrays of one pass (a word longer than a pass is summed in parts).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Characters hashed in one pass; a longer text is cut between words.
PASS_CHARS = 1 << 18
BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(BASE)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for twice a pass."""
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(2 * PASS_CHARS, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS


def run_hashes(values: np.ndarray, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of characters that are inside a word; at most two passes long.

    ``cuts`` are places inside of words that end one run and start another.
    """
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if cuts is not None and len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    up, down = _powers()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    raw = (total[ends] - total[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * _ODD), starts, ends


def long_word_hash(values: Callable[[int, int], np.ndarray], size: int) -> np.uint64:
    """The hash of one word of any length; ``values(a, b)`` gives the values of a part."""
    raw, factor, up = 0, 1, _powers()[0]
    for low in range(0, size, PASS_CHARS):
        part = values(low, min(size, low + PASS_CHARS))
        raw += factor * int((part * up[: len(part)]).sum(dtype=np.uint64))
        factor = factor * pow(BASE, len(part), 1 << 64) % (1 << 64)
    word = np.array([(raw + size * BASE) % (1 << 64)], np.uint64)
    return mixed(word)[0]


def passes(texts: list, gap: re.Pattern, limit: int = PASS_CHARS) -> Iterator[tuple[list, bool]]:
    """Pieces of texts, no more than about ``limit`` characters at a time.

    A long text is cut at the first ``gap`` after each ``limit`` characters; its pieces come
    alone and are marked as open, and its last piece leads the pass that follows.
    """
    pieces, size = [], 0
    for text in texts:
        low = 0
        while len(text) - low > limit:
            found = gap.search(text, low + limit)
            high = found.start() if found else len(text)
            if pieces:
                yield pieces, False
            yield [text[low:high]], True
            pieces, size, low = [], 0, high
        if pieces and size + len(text) - low > limit:
            yield pieces, False
            pieces, size = [], 0
        pieces.append(text[low:] if low else text)
        size += len(text) - low + 1
    if pieces:
        yield pieces, False


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTE_INSIDE = np.ones(256, bool)
_BYTE_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
BYTE_GAP = re.compile(rb"[\x20\x09-\x0d]")
_BYTE_RUN = re.compile(rb"[^\x20\x09-\x0d]+")
_CHAR_GAP = re.compile(r"\W")
_CHAR_RUN = re.compile(r"\w+")
_CHAR_TABLES: list[np.ndarray] = []


def byte_runs(data: bytes, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each run of bytes that are no ASCII white space, also cut at ``cuts``."""
    if len(data) > 2 * PASS_CHARS:  # a word longer than a pass
        flat = np.frombuffer(data, np.uint8)
        spans = [m.span() for m in _BYTE_RUN.finditer(data)]
        if cuts is not None:
            marks = sorted({x for span in spans for x in span} | set(cuts.tolist()))
            spans = [(a, b) for a, b in zip(marks, marks[1:]) if not BYTE_GAP.match(data, a)]
        hashes = [long_word_hash(lambda x, y, a=a: _BYTE_VALUES[flat[a + x : a + y]], b - a) for a, b in spans]
        at = np.array(spans, np.int64).reshape(-1, 2)
        return np.array(hashes, np.uint64), at[:, 0], at[:, 1]
    flat = np.frombuffer(data, np.uint8)
    return run_hashes(_BYTE_VALUES[flat], _BYTE_INSIDE[flat], cuts)


def _char_runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not _CHAR_TABLES:
        inside = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
        _CHAR_TABLES.extend([mixed(np.arange(1, 0x110001, dtype=np.uint64)), inside])
    values, inside = _CHAR_TABLES
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(text) > 2 * PASS_CHARS:
        spans = [m.span() for m in _CHAR_RUN.finditer(text)]
        hashes = [long_word_hash(lambda x, y, a=a: values[codes(text[a + x : a + y])], b - a) for a, b in spans]
        return np.array(hashes, np.uint64), np.array([a for a, _ in spans], np.int64)
    flat = codes(text)
    return run_hashes(values[flat], inside[flat])[:2]


def _by_text(texts: list, gap: re.Pattern, mark, runs: Callable) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per pass: all word hashes, and those of each text that ends in it."""
    held: list[np.ndarray] = []  # of a text that goes on
    for pieces, goes_on in passes(texts, gap):
        hashes, starts = runs(mark.join(pieces) + mark)[:2]
        if goes_on:
            held.append(hashes)
            continue
        cut = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]))
        if held:
            before = np.concatenate(held)
            hashes, cut, held = np.concatenate([before, hashes]), cut + len(before), []
        yield hashes, [hashes[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]


def byte_words(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per pass: all word hashes, and those of each text.

    Words lie between U+0020 and U+0009 to U+000D; A-Z are lower-cased.
    """
    yield from _by_text([(t or b"").lower() for t in texts], BYTE_GAP, b"\n", byte_runs)


def char_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Per pass: all word hashes, and those of each text.

    Words are runs of letters, digits and underscores (as ``\\w``), lower-cased.
    """
    yield from _by_text([(t or "").lower() for t in texts], _CHAR_GAP, "\n", _char_runs)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    size = max(0, len(words) - n + 1)
    out = words[:size].copy()
    for k in range(1, n):
        out = mixed(out) * _ODD + words[k : size + k]
    return mixed(out)
