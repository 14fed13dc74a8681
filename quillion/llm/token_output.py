"""Token ids in wavelet-matrix shards.

Documents are range-partitioned by id, encoded, joined in order and written as
shards.  A shard is one image: a bit-plane per bit of an id, each with a rank
directory, and the table of its documents.  An image alone supports access to any
token, counting of a token in a range, and lookup of a token's occurrences.  Images
travel as rows of a Parquet table, so any store that Spark can write will do.

Pieces of texts are encoded once by the library and known again by a 64-bit hash, so
equality with the library's ids holds but for colliding hashes of different words.

Defined results: a null text counts as empty and gives the end id alone; null ids
come first; rows with equal ids stay apart (ordered by a hash of their text); a
document of any length lies whole in one shard; the strings of special tokens in a text
are those tokens, as the library takes them; an empty table gives no shards and an
empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_at_most, scratch_path, tidy
from .hashing import BYTE_GAP, byte_runs, passes

#: A shard is closed when it holds this many tokens.
SHARD_TOKENS = 1 << 19
#: Bits between entries of a rank directory.
RANK_BITS = 512
MAGIC = b"WMX1"
#: Distinct pieces that a worker remembers before it starts anew.
CACHE_PIECES = 1_500_000
#: Pieces that are remembered apart until they are merged into the rest.
RECENT_PIECES = 50_000
#: Offsets of writing tasks are broadcast up to this many (16 bytes each), else shuffled.
BROADCAST_TASKS = 100_000
#: An ASCII letter or digit before an ASCII symbol other than the apostrophe: no token spans this place.
_BEFORE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))
_AFTER = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


#: Lower-case letters that the tokenizer's normaliser leaves as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WaveletMatrix:
    """Bit-planes of a sequence of ids, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], directories: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.directories = n, planes, zeros, directories

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rest = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, directories = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (rest >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            planes.append(np.append(packed, np.zeros(-len(packed) % (RANK_BITS // 8), np.uint8)))
            directories.append(_directory(planes[-1]))
            low, high = rest.take(np.flatnonzero(~bits)), rest.take(np.flatnonzero(bits))
            zeros.append(len(low))
            rest = np.concatenate([low, high])
        return cls(len(ids), planes, zeros, directories)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QI", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        body = b"".join(p.tobytes() + d.astype("<u4").tobytes() for p, d in zip(self.planes, self.directories))
        return head + body

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        n, levels = struct.unpack_from("<QI", data)
        zeros = list(struct.unpack_from(f"<{levels}Q", data, 12))
        at, planes, directories = 12 + 8 * levels, [], []
        blocks = -(-n // RANK_BITS)
        for _ in range(levels):
            planes.append(np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at))
            at += blocks * RANK_BITS // 8
            directories.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
        return cls(n, planes, zeros, directories)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many set bits of a plane come before each place."""
        block = at // RANK_BITS
        width = RANK_BITS // 8
        padded = np.append(self.planes[level], np.zeros(width, np.uint8))
        window = padded[(block * width)[:, None] + np.arange(width)]
        bits = np.unpackbits(window, axis=1, bitorder="little")
        inside = np.arange(RANK_BITS) < (at % RANK_BITS)[:, None]
        return self.directories[level][block].astype(np.int64) + (bits & inside).sum(1, dtype=np.int64)

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) bits of a kind in a plane: the directory gives the
        block, and only these blocks are unpacked."""
        before = self.directories[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * RANK_BITS - before
        block = np.searchsorted(before, k, "right") - 1
        width = RANK_BITS // 8
        window = self.planes[level].reshape(-1, width)[block]
        found = np.cumsum(np.unpackbits(window, axis=1, bitorder="little") == bit, axis=1, dtype=np.int32)
        return block * RANK_BITS + (found <= (k - before[block])[:, None]).sum(1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self.rank(level, at)
            at = np.where(bit, zeros + ones, at - ones)
            out = out << 1 | bit
        return out

    def interval(self, token: int, low: int, high: int) -> tuple[int, int]:
        """The interval of the last level that a token's occurrences in [low, high) lie in."""
        if token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank(level, np.array([low, high])).tolist()
            low, high = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in [low, high)."""
        low, high = self.interval(token, low, self.n if high is None else high)
        return max(0, high - low)

    def locate(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        low, high = self.interval(token, 0, self.n)
        out = []
        for first in range(low, high, 4096):  # bounds the blocks unpacked at once
            at = np.arange(first, min(high, first + 4096))
            for level in range(len(self.planes) - 1, -1, -1):
                bit = token >> (len(self.planes) - 1 - level) & 1
                at = self.select(level, bit, at - self.zeros[level] * bit)
            out.append(at)
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def decode(self) -> np.ndarray:
        """All ids: the partitions are undone from the last plane to the first."""
        levels = len(self.planes)
        out = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], bitorder="little")[: self.n].astype(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~bits)] = out[: self.zeros[level]]
            before[np.flatnonzero(bits)] = out[self.zeros[level] :] | out.dtype.type(1 << (levels - 1 - level))
            out = before
        return out


def _directory(plane: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(plane).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)


def shard_image(keys: list, counts: list[int], ids: np.ndarray) -> bytes:
    """One shard: magic, documents, their ids and lengths, the wavelet matrix."""
    known = np.array([k is not None for k in keys], np.uint8)
    table = known.tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(counts, "<i8").tobytes()
    return MAGIC + struct.pack("<Q", len(keys)) + table + WaveletMatrix.of(ids).to_bytes()


def open_shard(image: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, token counts and matrix of a shard."""
    if image[:4] != MAGIC:
        raise ValueError("not a shard image")
    (n,) = struct.unpack_from("<Q", image, 4)
    known = np.frombuffer(image, np.uint8, n, 12)
    keys = np.frombuffer(image, "<i8", n, 12 + n).tolist()
    counts = np.frombuffer(image, "<i8", n, 12 + 9 * n)
    return [k if ok else None for k, ok in zip(keys, known)], counts, WaveletMatrix.from_bytes(memoryview(image)[12 + 17 * n :])


class HashTable:
    """Numbers of known 64-bit hashes: a large sorted array, and a small one of recent ones."""

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, numbers[at], out)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new hashes, which are distinct and in ascending order."""
        numbers = np.arange(self.size, self.size + len(hashes))
        self.size += len(hashes)
        self.parts[1] = _merged(self.parts[1], (hashes, numbers))
        if len(self.parts[1][0]) > RECENT_PIECES:
            self.parts = [_merged(*self.parts), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class PieceEncoder:
    """Texts to ids through the tokenizers library, remembering pieces.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its parts between ASCII white space; and no token spans a place between ``_BEFORE``
    and ``_AFTER``.  Pieces are found, hashed and looked up as arrays; each distinct one
    is encoded once by the library.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content.lower().encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known = HashTable()
        self.table = np.zeros(0, np.uint32)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids: list[list[int]] = []
        other: list[int] = []
        texts = [p.decode("utf-8") for p in pieces]
        for k, p in enumerate(texts):
            if PLAIN.fullmatch(p):  # normalised already, and one pre-token: only the merges are left
                ids.append([x.id for x in tokenize(p if p.isascii() else "".join([letters[b] for b in pieces[k]]))])
            else:
                ids.append([])
                other.append(k)
        for low in range(0, len(other), 20_000):
            part = other[low : low + 20_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
                ids[k] = e.ids
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for one in ids for x in one], np.uint32)
        self.known.add(hashes)
        self.begins = np.concatenate([self.begins, np.cumsum(sizes) - sizes + len(self.table)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.table = np.concatenate([self.table, flat])

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of some joined texts, and where it starts."""
        flat = np.frombuffer(data, np.uint8)
        cut = np.flatnonzero(_BEFORE[flat[:-1]] & _AFTER[flat[1:]]) + 1
        hashes, starts, ends = byte_runs(data, cut)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = self.known.find(distinct)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.known.size > CACHE_PIECES:
                self.forget()
                new = np.arange(len(distinct))
            at = first[new]
            self._learn(distinct[new], [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            found[new] = np.arange(self.known.size - len(new), self.known.size)
        return found[inverse], starts

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and how many each text has."""
        data = [(t or "").encode("utf-8").lower() for t in texts]
        ids, counts, low = [], [], 0
        for k, d in enumerate(data):
            if any(s in d for s in self.special):  # a token may span what is a cut elsewhere
                whole = self.tokenizer.encode(texts[k], add_special_tokens=False).ids
                self._encode(data[low:k], end_id, ids, counts)
                ids.append(np.array([*whole, end_id], np.uint32))
                counts.append(np.array([len(whole) + 1]))
                low = k + 1
        self._encode(data[low:], end_id, ids, counts)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _encode(self, data: list[bytes], end_id: int, ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        open_ids = 0
        for pieces, goes_on in passes(data, BYTE_GAP):
            where, starts = self._numbers(b"\n".join(pieces) + b"\n")
            sizes = self.sizes[where]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.table[np.repeat(self.begins[where] - (ends - sizes), sizes) + np.arange(total)]
            if goes_on:
                ids.append(flat)
                open_ids += total
                continue
            upto = np.concatenate([[0], ends])[np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]))]
            ids.append(np.insert(flat, upto, np.uint32(end_id)))
            each = np.diff(upto, prepend=0) + 1
            each[0] += open_ids
            counts.append(each)
            open_ids = 0


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]


SHARD_SCHEMA = "part int, seq int, start_in_part bigint, n_tokens bigint, n_docs bigint, image binary"


def _build(batches: Iterator[pa.RecordBatch], name: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    tool, seq, start = encoder(name), 0, 0
    keys: list = []
    counts: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def shard() -> pa.RecordBatch:
        nonlocal seq, start, keys, counts, ids
        flat, sizes = np.concatenate(ids), np.concatenate(counts)
        row = [[part], [seq], [start], [len(flat)], [len(keys)], [shard_image(keys, sizes.tolist(), flat)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        seq, start, keys, counts, ids = seq + 1, start + len(flat), [], [], []
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seq", "start_in_part", "n_tokens", "n_docs", "image"])

    for batch in batches:
        for low in range(0, batch.num_rows, 128):
            some = batch.slice(low, 128)
            flat, sizes = tool.encode(some.column(1).to_pylist(), end_id)
            keys += some.column(0).to_pylist()
            ids.append(flat)
            counts.append(sizes)
            if sum(map(len, ids)) >= SHARD_TOKENS:
                yield shard()
    if keys:
        yield shard()


def write_shards(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts in ascending id order and write the shards.

    The text crosses one range shuffle (sampled on ids, before any encoding); the ids
    are made in the task that writes them.  A range bound takes the text's hash as well,
    so rows that share one id still spread.
    """
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    shards = rows.mapInArrow(lambda batches: tidy(_build(batches, tokenizer, end_id)), SHARD_SCHEMA)
    small = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "1"}
    shards.write.option("compression", "zstd").options(**small).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, image in zip(*(batch.column(k).to_pylist() for k in range(3))):
            keys, counts, matrix = open_shard(image)
            ids = matrix.decode().astype("<u4")
            ends = np.cumsum(counts)
            cut = ends.tolist()
            data = [ids[a:b].tobytes() for a, b in zip([0, *cut], cut)]
            arrays = [
                pa.array(keys, pa.int64()),
                pa.array([part] * len(keys), pa.int32()),
                pa.array(start + ends - counts, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(data, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "part", "start_in_part", "n_tokens", "ids"])


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the shards: id, start, n_tokens, ids (32-bit little-endian).

    The first id of each writing task comes from a running sum over tasks, a row each and
    as many as shuffle partitions; they are broadcast if they are few.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.select("part", "start_in_part", "image").mapInArrow(_read, "id bigint, part int, start_in_part bigint, n_tokens bigint, ids binary")
    rows = rows.join(F.broadcast(base) if rows_at_most(parts, BROADCAST_TASKS) else base, "part")
    return rows.select(F.col("id").alias(id_col), (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of a token by shard, from rank queries alone: part, seq, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [open_shard(x)[2].count(token) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["part", "seq", "n"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return shards.select("part", "seq", "image").mapInArrow(count, "part int, seq int, n bigint")


def encode_table(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read the documents back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs, path, tokenizer, end_id, id_col, text_col)
    return read_documents(spark, path, id_col)
