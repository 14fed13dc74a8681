"""Byte-level BPE: encoding and decoding without a regular expression.

Pre-tokenisation is array work.  Code points are mapped to classes; two look-ahead
rules (end of a white-space run, contractions) refine the class; each class is a
transition function on eight automaton states.  Functions compose associatively, so
block products are scanned instead of characters, and all token starts of a batch
come out of a few array passes.  The slices between starts feed pair merging, which
works on all unseen slices at once and caches what it finds.  Each id keeps the byte
offset at which its token ends; decoding puts every token's bytes at the place that its
offset names, and a span of bytes is decoded without the tokens around it.

Defined results: a null text counts as empty and gives no ids; very long texts are
taken in passes (cut at a blank between two words, where a token always starts) and
give the ids of the whole; single slices of any length are whole (long slices take a
heap-driven merge in n log n); offsets that do not fit their ids are an error, null ids
decode to no bytes; repeated rows are encoded each by itself; an empty table gives an
empty table; input columns named like an output column are replaced, all others stay.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, tidy
from .hashing import passes

# Symbols: what a character is to the automaton.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_BEFORE, BREAK_BEFORE, GAP, RESET = range(9)
# States: what the current token is so far.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, JOINED, ONE_LEFT, TWO_LEFT = range(8)
#: A place where a token starts whatever comes before: a blank between two words.
BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")
#: Tokens that are put together at once in decoding; bounds the working arrays.
PASS_TOKENS = 1 << 18
#: Distinct slices that a worker remembers before it starts anew.
CACHE_SLICES = 300_000
#: Longer slices are merged one by one with a heap.
LONG_SLICE = 128
NO_PAIR = np.iinfo(np.int64).max


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by symbol and state."""
    step = np.zeros((9, 8), np.uint8)
    start = np.ones((9, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for symbol, state in runs.items():
        step[symbol] = state
        start[symbol, [state, JOINED]] = False
    for symbol, state in ((QUOTE2, ONE_LEFT), (QUOTE3, TWO_LEFT)):
        step[symbol] = state
        step[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS
        start[symbol, [IN_OTHERS, JOINED]] = False
    step[LETTER, [ONE_LEFT, TWO_LEFT]] = FRESH, ONE_LEFT
    start[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    step[SPACE_BEFORE], step[BREAK_BEFORE], step[GAP], step[RESET] = JOINED, FRESH, IN_GAP, FRESH
    start[GAP, IN_GAP] = False
    start[RESET] = False
    return step, start


STEP, START = _automaton()


def scan_states(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each symbol, by composing transition functions over blocks."""
    n = len(symbols)
    if n <= block:
        out, state = np.empty(n, np.uint8), FRESH
        for i, s in enumerate(symbols.tolist()):
            out[i], state = state, STEP[s, state]
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat = STEP.ravel()
    images = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # each block's function
    for column in grid:
        images = flat[(column.astype(np.uint16) << 3)[:, None] | images]
    entry = _scan_functions(images)
    out = np.empty((block, rows), np.uint8)
    for k, column in enumerate(grid):
        out[k] = entry
        entry = flat[(column.astype(np.uint16) << 3) | entry]
    return out.T.reshape(-1)[:n]


def _scan_functions(images: np.ndarray) -> np.ndarray:
    """The state before each block: an exclusive prefix scan of function composition."""
    rows = len(images)
    shift = 1
    total = images
    while shift < rows:
        later = total.copy()
        later[shift:] = np.take_along_axis(total[shift:], total[:-shift], 1)
        total, shift = later, shift * 2
    out = np.full(rows, FRESH, np.uint8)
    out[1:] = total[:-1, FRESH]
    return out


class Numbered(dict):
    """Numbers slices as they are first asked for; ``new`` lists the unencoded ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class ByteBpe:
    """Encoder and decoder for one rank file; one per worker, with its cache."""

    def __init__(self, data: bytes):
        lines = (x.split() for x in data.splitlines() if x.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.begin_of = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs = None  # made when first encoding
        self.forget()

    def prepare(self) -> None:
        """What only encoding needs: ids of bytes, ranks of id pairs, character classes."""
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, made = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        self.classes = code_point_classes()

    # -- slices ---------------------------------------------------------------
    def starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token starts in joined texts; ``ends`` are the places of the separators."""
        kind = self.classes[codes]
        kind[ends] = RESET
        after = np.full(len(codes) + 2, RESET, np.uint8)
        after[: len(codes)] = kind
        nxt = after[1:-1]
        space = kind == GAP
        before_text = space & (nxt != GAP) & (nxt != RESET)
        kind[before_text] = np.where(codes[before_text] == 32, SPACE_BEFORE, BREAK_BEFORE).astype(np.uint8)
        quotes = np.flatnonzero(codes == 39)
        if len(quotes):
            padded = np.append(codes, [0, 0])
            padded[ends] = 0
            one, two = padded[quotes + 1], padded[quotes + 2]
            has = lambda x, chars: np.isin(x, [ord(c) for c in chars])
            kind[quotes[has(one, "stmd")]] = QUOTE2
            three = (has(one, "rv") & has(two, "e")) | (has(one, "l") & has(two, "l"))
            kind[quotes[three]] = QUOTE3
            kind[ends] = RESET
        return np.flatnonzero(START[kind, scan_states(kind)])

    def slices(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All slices of all texts, and how many there are up to the end of each text."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = self.starts(codes, ends)
        cuts = np.zeros(len(codes), np.uint8)
        cuts[at] = 1
        cuts[ends] = 2
        bounds = np.flatnonzero(cuts)
        stops = bounds[1:][cuts[bounds[:-1]] == 1]
        return [joined[a:b] for a, b in zip(at.tolist(), stops.tolist())], np.searchsorted(at, ends)

    # -- merging --------------------------------------------------------------
    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NO_PAIR)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short slices at once, joined, and how many each slice has.

        Each round merges the leftmost least pair of every slice; only the two pairs
        beside a merge are looked up again.
        """
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(flat), NO_PAIR)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._ranks_of(flat[inner], flat[inner + 1])
        done_ids, done_owner = [], []
        while len(flat):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(flat)))
            done = np.repeat(least == NO_PAIR, size)
            done_ids.append(flat[done])
            done_owner.append(owner[done])
            hit = np.flatnonzero((rank == np.repeat(least, size)) & ~done)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit
            flat[hit] = rank[hit]
            keep = ~done
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            rank[at] = NO_PAIR
            right = at[(at + 1 < len(flat))]
            right = right[owner[right] == owner[right + 1]]
            rank[right] = self._ranks_of(flat[right], flat[right + 1])
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            rank[left] = self._ranks_of(flat[left], flat[left + 1])
        whose = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(whose, kind="stable")
        ids = np.concatenate(done_ids)[order] if done_ids else np.zeros(0, np.int64)
        return ids.astype(np.uint32), np.bincount(whose, minlength=len(pieces))

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long slice: least pair first from a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        get, tokens = self.ranks.get, self.tokens
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = get(tokens[ids[i]] + tokens[ids[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x, ok in zip(ids, alive) if ok], np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Append the ids of new slices to the table."""
        encoded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for low in range(0, len(encoded), 200_000):
            part = encoded[low : low + 200_000]
            short = [p if len(p) <= LONG_SLICE else p[:1] for p in part]
            ids, sizes = self.merge_all(short)
            long = [k for k, p in enumerate(part) if len(p) > LONG_SLICE]
            if long:
                split = np.split(ids, np.cumsum(sizes)[:-1])
                for k in long:
                    split[k] = self.merge_long(part[k])
                ids, sizes = np.concatenate(split), np.array([len(x) for x in split])
            begins = np.cumsum(sizes) - sizes + len(self.table)
            self.table = np.concatenate([self.table, ids])
            self.begins = np.concatenate([self.begins, begins])
            self.sizes = np.concatenate([self.sizes, sizes])

    def forget(self) -> None:
        self.cache, self.table = Numbered(), np.zeros(0, np.uint32)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- texts ----------------------------------------------------------------
    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text, and the byte offset at which each id's token ends."""
        if self.pairs is None:
            self.prepare()
        out_ids, out_ends, held = [], [], []
        for pieces, goes_on in passes(texts, BETWEEN_WORDS):
            slices, upto = self.slices(pieces)
            if len(self.cache) > CACHE_SLICES:
                self.forget()
            where = np.fromiter(map(self.cache.__getitem__, slices), np.int64, len(slices))
            if self.cache.new:
                new, self.cache.new = self.cache.new, []
                self._learn(new)
            sizes = self.sizes[where]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.table[np.repeat(self.begins[where] - (ends - sizes), sizes) + np.arange(total)]
            if goes_on:
                held.append(flat)
                continue
            cut = np.concatenate([[0], ends])[upto]
            if held:  # the first of these pieces ends a longer text
                before = np.concatenate(held)
                flat, cut, held = np.concatenate([before, flat]), cut + len(before), []
            passed = np.concatenate([[0], np.cumsum(self.lengths[flat])])
            cut = cut.tolist()
            for a, b in zip([0, *cut[:-1]], cut):
                out_ids.append(flat[a:b])
                out_ends.append(passed[a + 1 : b + 1] - passed[a])
        return out_ids, out_ends

    def _placed(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of consecutive tokens, each at the place that its end names."""
        sizes = self.lengths[ids]
        begins = ends.astype(np.int64) - sizes
        if len(ids) and ((begins[1:] != ends[:-1]).any() or begins[0] < 0):
            raise ValueError("offsets do not fit the ids")
        first = int(begins[0]) if len(ids) else 0
        total = int(sizes.sum())
        return self.flat[np.repeat(self.begin_of[ids] - (begins - first), sizes) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """The bytes of a text's ids; without stored offsets, these are counted anew."""
        if ends is None:
            ends = np.cumsum(self.lengths[ids])
        elif len(ends) != len(ids) or (len(ids) and int(ends[0]) != self.lengths[ids[0]]):
            raise ValueError("offsets do not fit the ids")
        if len(ids) <= PASS_TOKENS:
            return self._placed(ids, ends)
        return b"".join(self._placed(ids[low : low + PASS_TOKENS], ends[low : low + PASS_TOKENS]) for low in range(0, len(ids), PASS_TOKENS))

    def decode_span(self, ids: np.ndarray, ends: np.ndarray, start: int, stop: int) -> bytes:
        """The bytes from ``start`` to ``stop`` of a text, from the tokens that touch them."""
        first, last = np.searchsorted(ends, [start, stop - 1], "right").tolist()
        if stop <= start or first >= len(ids):
            return b""
        found = self._placed(ids[first : last + 1], ends[first : last + 1])
        skipped = start - (int(ends[first]) - int(self.lengths[ids[first]]))
        return found[skipped : skipped + stop - start]


_CLASSES: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, GAP or OTHER for every code point, as the tokenizer's own library sees them."""
    global _CLASSES
    if _CLASSES is None:
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        classes = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", GAP)):
            known = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            members = known.decode(known.encode_ordinary(every))
            classes[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
        _CLASSES = classes
    return _CLASSES


_CODECS: dict[str, ByteBpe] = {}


def codec(name: str, data: bytes | None = None) -> ByteBpe:
    """The worker's codec for a rank file of the installed public tokenizers."""
    if name not in _CODECS:
        if data is None:
            import public_tokenizers

            with open(public_tokenizers.path(name), "rb") as f:
                data = f.read()
        _CODECS[name] = ByteBpe(data)
    return _CODECS[name]


def _encode_batches(batches: Iterator[pa.RecordBatch], text_col: str, ranks: str, keep: list[str], ends_col: str = "ends") -> Iterator[pa.RecordBatch]:
    bpe = codec(ranks)
    bpe.forget()
    for whole in batches:
        for low in range(0, whole.num_rows, 512):  # bounds the ids held at once
            batch = whole.slice(low, 512)
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ids, ends = bpe.encode(texts)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([x.astype("<u4").tobytes() for x in ends], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "ids", ends_col])
    bpe.forget()  # the worker may go on to other work


def _decode_batches(batches: Iterator[pa.RecordBatch], ranks: str, ends_col: str | None, drop_ends: bool) -> Iterator[pa.RecordBatch]:
    bpe = codec(ranks)
    ints = lambda x: np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else None
    for whole in batches:
        for low in range(0, whole.num_rows, 512):
            batch = whole.slice(low, 512)
            ids = batch.column(batch.schema.get_field_index("ids"))
            ends = batch.column(batch.schema.get_field_index(ends_col)) if ends_col else [None] * len(ids)
            texts = [bpe.decode(ints(x), ints(e) if ends_col else None) if x.is_valid else b"" for x, e in zip(ids, ends)]
            if drop_ends:
                batch = batch.drop_columns(ends_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])


def encode_texts(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """Replace the text by n_tokens, ids and ends (little-endian unsigned 32-bit integers).

    ``ends`` holds the byte offset after each token, so a span of ids can be traced
    to its place in the text.  A map over partitions: no shuffle.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text_col, "n_tokens", "ids", "ends")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])
    return docs.select(*names, text_col).mapInArrow(lambda batches: tidy(_encode_batches(batches, text_col, ranks, names)), schema)


def decode_ids(rows: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``, through the offsets in ``ends`` where there are any."""
    rows = rows.drop("decoded")
    ends = "ends" if "ends" in rows.columns else None
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(lambda batches: tidy(_decode_batches(batches, ranks, ends, False)), schema)


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """Replace the text by n_tokens, ids and decoded, in one pass of one worker per task.

    As :func:`decode_ids` of :func:`encode_texts`; the offsets do not leave the worker.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text_col, "n_tokens", "ids", "decoded")]
    names = [f.name for f in keep]
    ends = fresh(names, "ends")
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _encode_batches(batches, text_col, ranks, names, ends)
        return tidy(_decode_batches(coded, ranks, ends, True))

    return docs.select(*names, text_col).mapInArrow(both, schema)
