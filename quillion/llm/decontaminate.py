"""Benchmark passages in documents: item-sized windows, SimHash, exact check.

For each distinct size of a benchmark item, a document's windows of that size get a
SimHash fingerprint of their word shingles.  Items are stored in a multi-index: the
64 bits are cut into seven blocks, and an item is listed under every block value within
distance two of its own, so a look-up by the window's own block values finds every item
whose fingerprint lies within twenty bits.  Found pairs are verified by the exact
similarity of the two weighted shingle sets (weights: how often a shingle occurs).

Before that, an exact filter: a window can only reach the similarity if so many of its
shingles occur in some item of its size; windows below that count are not fingerprinted,
which loses nothing.  Fingerprints of texts at the threshold differ in about ten bits, 20
bits being more than three standard deviations above.

Words are Unicode letters, digits and underscores, lower-cased; shingles have five words
(or all words of a shorter item).

Defined results: documents and items without text match nothing; an item without an id is
matched like any other and shows as null; a document shorter than an item is one window;
repeated rows match each by itself, as repeated items do; empty tables give empty results;
of several windows that match one item, the most similar, then the first, is returned;
matching reads id and text only; :func:`drop_contaminated` keeps all columns, whatever
their names.  Texts of any length are taken in parts of bounded size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .hashing import char_words, sequence_hashes

SHINGLE = 5
PERCENT = 80
RADIUS = 20
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Items are taken in blocks of about this many, which bounds what is broadcast.
ITEMS_PER_BLOCK = 20_000
GATE_BITS = 1 << 22
#: Windows that are fingerprinted from one running total; bounds the working arrays.
PASS_WINDOWS = 1 << 14


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(len(shingles), 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(totals: np.ndarray) -> np.ndarray:
    """The fingerprint of summed signs."""
    return np.packbits(totals > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def window_prints(shingles: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows, some at a time, and their fingerprints; ``at`` is ascending."""
    low = 0
    while low < len(at):
        first = int(at[low])
        high = int(np.searchsorted(at, first + PASS_WINDOWS))
        part = shingles[first : int(at[high - 1]) + size]
        totals = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(part), 0, dtype=np.int32)])
        here = at[low:high]
        yield here, packed(totals[here - first + size] - totals[here - first])
        low = high


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in BLOCKS:
        out.append(((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


class ItemIndex:
    """Items of one shingle length and size, by block values."""

    def __init__(self, shingle: int, size: int, items: list[tuple[int, np.ndarray]]):
        self.shingle, self.size = shingle, size
        self.numbers = [i for i, _ in items]
        self.bags = [Counter(s.tolist()) for _, s in items]
        self.prints = packed(np.array([signs(s).sum(0) for _, s in items]))
        self.tables = []
        for width, values in zip(BLOCKS, block_values(self.prints)):
            masks = [0, *(1 << a for a in range(width)), *(1 << a | 1 << b for a, b in combinations(range(width), 2))]
            key = (values[:, None] ^ np.array(masks)).ravel()
            item = np.repeat(np.arange(len(values)), len(masks))
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], item[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        windows, items = [], []
        for (keys, listed), values in zip(self.tables, block_values(prints)):
            low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
            n = high - low
            windows.append(np.repeat(np.arange(len(values)), n))
            items.append(listed[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        pairs = np.unique(np.concatenate(windows) * len(self.numbers) + np.concatenate(items))
        window, item = pairs // len(self.numbers), pairs % len(self.numbers)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Benchmark:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str | None]], percent: int):
        self.percent = percent
        self.ids = [i for i, _ in items]  # items are told apart by their number, ids may repeat or be null
        by: dict[tuple[int, int], list] = defaultdict(list)
        members = defaultdict(list)
        hashes = [w for _, each in char_words([t for _, t in items]) for w in each]
        for number, words in enumerate(hashes):
            if len(words):
                k = min(SHINGLE, len(words))
                shingles = sequence_hashes(words, k)
                by[k, len(shingles)].append((number, shingles))
                members[k].append(shingles)
        self.classes = [ItemIndex(k, m, x) for (k, m), x in sorted(by.items())]
        self.members = {k: np.unique(np.concatenate(x)) for k, x in members.items()}
        # Which sizes of item each known shingle occurs in.
        self.of_class = {}
        for k, known in self.members.items():
            own = [c for c in self.classes if c.shingle == k]
            table = np.zeros((len(known), len(own)), bool)
            for column, index in enumerate(own):
                for bag in index.bags:
                    table[np.searchsorted(known, np.array(list(bag), np.uint64)), column] = True
            self.of_class[k] = (own, table)
        self.gates = {}
        for k, known in self.members.items():
            gate = np.zeros(GATE_BITS, bool)
            gate[(known & np.uint64(GATE_BITS - 1)).astype(np.int64)] = True
            self.gates[k] = np.packbits(gate, bitorder="little")

    def matches(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, float]]]:
        """(item, first word, words, similarity) of each item found in each text."""
        for joined, each in char_words(texts):
            maybe = {k: self._maybe(k, sequence_hashes(joined, k)) for k in self.members}
            at = 0
            for words in each:
                near = {k: m[slice(*np.searchsorted(m, [at, at + len(words) - k + 1]))] - at for k, m in maybe.items() if len(words) >= k}
                yield self._in_text(words, {k: m for k, m in near.items() if len(m)})
                at += len(words)

    def _maybe(self, k: int, shingles: np.ndarray) -> np.ndarray:
        """Places whose shingle passes the gate."""
        cell = (shingles & np.uint64(GATE_BITS - 1)).astype(np.int64)
        return np.flatnonzero(self.gates[k][cell >> 3] >> (cell & 7).astype(np.uint8) & 1)

    def _in_text(self, words: np.ndarray, near: dict[int, np.ndarray]) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[float, int, int]] = {}
        for k, maybe in near.items():
            known, shingles = self.members[k], sequence_hashes(words, k)
            place = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
            sure = known[place] == shingles[maybe]
            found = maybe[sure]
            own, table = self.of_class[k]
            held = table[place[sure]]
            counts = held.sum(0)
            for column, index in enumerate(own):
                size = min(index.size, len(shingles))
                need = -(-self.percent * (size + index.size) // (100 + self.percent))
                if counts[column] < need:
                    continue
                listed = np.zeros(len(shingles) + 1, np.int64)
                listed[found[held[:, column]] + 1] = 1
                listed = np.cumsum(listed)
                at = np.flatnonzero(listed[size:] - listed[:-size] >= need)
                if not len(at):
                    continue
                for places, prints in window_prints(shingles, at, size):
                    window, item = index.near(prints)
                    for w, i in zip(places[window].tolist(), item.tolist()):
                        bag = Counter(shingles[w : w + size].tolist())
                        common = sum((bag & index.bags[i]).values())
                        union = size + index.size - common
                        if common * 100 >= union * self.percent:
                            got = (common / union, -w, size + k - 1)
                            best[index.numbers[i]] = max(best.get(index.numbers[i], got), got)
        return [(self.ids[i], -w, n, s) for i, (s, w, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items, a block of about ``ITEMS_PER_BLOCK`` at a time; ids and texts decide the block."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    parts = max(1, -(-rows.count() // ITEMS_PER_BLOCK))
    for part in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").collect()]


def _match(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index = shared.value
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["id", "item_id", "start_word", "n_words", "similarity"]
    for batch in batches:
        rows = [(i, *m) for i, found in zip(batch.column(0).to_pylist(), index.matches(batch.column(1).to_pylist())) for m in found]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def find_passages(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item_id, start_word, n_words, similarity.

    A map over partitions for each block of items: documents never move.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text):
        shared = sc.broadcast(Benchmark(items, percent))
        found = rows.mapInArrow(lambda b, s=shared: tidy(_match(b, s)), "id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _clean(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        yield batch.filter(pa.array([not found for found in index.matches(texts)], pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item; all columns stay."""
    sc = docs.sparkSession.sparkContext
    for items in item_blocks(benchmark, item_col, item_text):
        shared = sc.broadcast(Benchmark(items, percent))
        docs = docs.mapInArrow(lambda b, s=shared: tidy(_clean(b, s, text_col)), docs.schema)
    return docs
