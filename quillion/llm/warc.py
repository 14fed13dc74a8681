"""WARC archives: writing with segments and chunked payloads, reading and reassembly.

A response whose block is longer than ``segment_bytes`` is cut into a first record and
continuation records (WARC-Segment-Origin-ID, WARC-Segment-Number, and the total length
on the last).  Payloads travel in chunked transfer framing.  Files are written by
Spark's own writer, so any store will do, and read back as whole files whose size the
writer bounds by a count of records.

Reading: records are parsed by their Content-Length; segments of one origin are
grouped, ordered by number and joined; the HTTP head is split off and the chunked
framing undone.  A record is ``complete`` = false, without a payload, if a segment is
missing, a total length does not fit, the file ends within it, its length or numbers
can't be read, or its chunked framing is broken; reading goes on at the next record.

Defined results: a null payload counts as empty; null keys are written and read as null;
rows that repeat the first record's key and payload are responses too (a revisit always
refers to a smaller key, or, with a null key, to any); an empty table gives an empty
result; only the three named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_at_most, scratch_path, tidy

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2048
#: Shorter payloads are never revisits.
MIN_REVISIT_BYTES = 100
#: Copies of one payload are spread over this many join keys.
SALTS = 16
#: Repeated payloads are broadcast up to this many (under 100 bytes each).
BROADCAST_DIGESTS = 50_000
EOL = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*[(F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts])


def _cuts(data: Column, width: int) -> Column:
    """Start offsets (from 1) of the slices of a binary value."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(width))


def chunked(payload: Column, width: int = CHUNK_BYTES) -> Column:
    """A payload in chunked transfer framing."""

    def frame(at: Column) -> Column:
        piece = F.substr(payload, at, F.lit(width))
        return _bytes(F.lower(F.hex(F.octet_length(piece))), EOL, piece, EOL)

    frames = F.transform(_cuts(payload, width), frame)
    body = F.aggregate(frames, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return F.when(F.octet_length(payload) == 0, _bytes("0" + END)).otherwise(_bytes(body, "0" + END))


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to to rows of key, url, payload.

    Digests are counted with partial aggregation; only digests that occur more than
    once meet the rows again, broadcast if they are few, else in a join whose keys are
    salted, so that a payload with a third of all rows is spread.
    """
    rows = pages.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    long = rows.where(F.col("payload_bytes") >= min_bytes)
    repeated = long.groupBy("payload_digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    repeated = repeated.where("n > 1").select(F.col("payload_digest").alias("of"), "first")
    if rows_at_most(repeated, BROADCAST_DIGESTS):
        met = rows.join(F.broadcast(repeated), F.col("payload_digest") == F.col("of"), "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        met = rows.join(salted, (F.col("payload_digest") == F.col("of")) & (F.col("_salt") == F.col("salt")), "left")
    return met.select("key", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one response or revisit per row, long responses in segments."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = with_originals(rows).withColumn("row", F.monotonically_increasing_id())
    revisit = F.col("refers_to").isNotNull()
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    status = "HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL
    whole = _bytes(status + "Transfer-Encoding: chunked" + END, chunked(F.col("payload")))
    short = _bytes(status + "Content-Length: ", F.col("payload_bytes").cast("string"), END)
    rows = rows.withColumn("block", F.when(revisit, short).otherwise(whole))
    cuts = F.when(revisit, F.array(F.lit(1))).otherwise(_cuts(F.col("block"), segment_bytes))
    rows = rows.withColumn("cuts", cuts).select("*", F.posexplode("cuts").alias("seg", "at"))
    piece = F.when(revisit, F.col("block")).otherwise(F.substr(F.col("block"), F.col("at"), F.lit(segment_bytes)))
    many, first, last = F.size("cuts") > 1, F.col("seg") == 0, F.col("seg") == F.size("cuts") - 1
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    origin = F.concat(F.lit("<urn:quillion:record:"), F.col("row").cast("string"), F.lit(":0>"))
    own = F.concat(F.lit("<urn:quillion:record:"), F.col("row").cast("string"), F.lit(":"), F.col("seg").cast("string"), F.lit(">"))
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    head = F.concat(
        F.lit("WARC/1.1" + EOL + "WARC-Type: "), kind,
        F.lit(EOL + "WARC-Record-ID: "), own,
        F.lit(EOL + "WARC-Date: " + DATE + EOL + "WARC-Target-URI: "), target,
        F.lit(EOL + "WARC-Page-Key: "), name("key"),
        F.when(first, F.concat(F.lit(EOL + "WARC-Payload-Digest: sha256:"), F.col("payload_digest"))).otherwise(""),
        F.when(revisit, F.concat(F.lit(EOL + "WARC-Profile: " + PROFILE + EOL + "WARC-Refers-To-Key: "), name("refers_to"))).otherwise(""),
        F.when(many, F.concat(F.lit(EOL + "WARC-Segment-Number: "), (F.col("seg") + 1).cast("string"))).otherwise(""),
        F.when(many & ~first, F.concat(F.lit(EOL + "WARC-Segment-Origin-ID: "), origin)).otherwise(""),
        F.when(many & last, F.concat(F.lit(EOL + "WARC-Segment-Total-Length: "), F.octet_length("block").cast("string"))).otherwise(""),
        F.lit(EOL + "Content-Type: application/http;msgtype=response" + EOL + "Content-Length: "),
        F.octet_length(piece).cast("string"), F.lit(END),
    )
    # Each record ends in two line ends, which the writer puts after every row.
    records = rows.select(_bytes(head, piece).cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;.*)?", re.S)
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_NUMBER = ("WARC-Page-Key", "WARC-Refers-To-Key", "WARC-Segment-Number", "WARC-Segment-Total-Length")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields and block of each record of an uncompressed archive.

    The block is None where the length is missing or unreadable, or the data end before it.
    """
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        head = data[at : stop if stop >= 0 else len(data)]
        fields = {a.decode("latin-1"): b.decode("utf-8", "replace").strip() for a, b in _FIELD.findall(head, max(0, head.find(b"\r\n")))}
        size = _number(fields.get("Content-Length"))
        if stop < 0 or size is None:
            yield fields, None
            at += 5
            continue
        block = data[stop + 4 : stop + 4 + size]
        yield fields, block if len(block) == size else None
        at = stop + 4 + len(block)


def _signed(text: str | None) -> int | None:
    found = _number(text.removeprefix("-")) if text else None
    return -found if found is not None and text.startswith("-") else found


def _number(text: str | None) -> int | None:
    """A number from 0 to the greatest of 63 bits, or None."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data))
        except zlib.error:  # what came before it still counts
            break
        data = one.unused_data
    return b"".join(out) if out else data


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response, its chunked framing undone; None if that is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return body
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = _CHUNK_SIZE.fullmatch(body[at:stop]) if stop >= 0 else None
        if not size:
            return None
        size = int(size[1], 16)
        if size == 0:
            return b"".join(out)
        if body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            return None
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size


RECORD_SCHEMA = (
    "record_id string, record_type string, key bigint, refers_to bigint, digest string, origin string, "
    "seg int, total bigint, block binary"
)


def _parse(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for f, block in parse_records(gunzip(content)):
                if ("WARC-Segment-Number" in f) != segmented:
                    continue
                page, refers = (_signed(f.get(k)) for k in _NUMBER[:2])
                seg, total = (_number(f.get(k)) for k in _NUMBER[2:])
                own = f.get("WARC-Record-ID")
                digest = f.get("WARC-Payload-Digest", "").rpartition(":")[2] or None
                seg = seg if seg is None or seg < 1 << 31 else None
                rows.append((own, f.get("WARC-Type"), page, refers, digest, f.get("WARC-Segment-Origin-ID", own), seg, total, block))
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def stated_length(block: bytes) -> int | None:
    """Content-Length of a stored HTTP head."""
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block.partition(b"\r\n\r\n")[0])
    return int(found[1]) if found else None


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, kinds, complete = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "record_type", "complete"))
        found = [http_payload(x) if x is not None and k == "response" else None for x, k in zip(blocks, kinds)]
        complete = [c and (p is not None or k != "response") for c, p, k in zip(complete, found, kinds)]
        sizes = [len(p) if p is not None else stated_length(x or b"") for p, x in zip(found, blocks)]
        arrays = [*batch.columns[:5], pa.array(complete, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:5], "complete", "payload_bytes", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives: record_id, record_type, key, refers_to, digest, complete, payload_bytes, payload.

    A revisit has no payload; its payload_bytes is the length that its HTTP head states.

    Records in one piece never move.  Only segments are shuffled, by origin; a group is
    one record, so no larger than the record itself.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(lambda b: tidy(_parse(b, False)), RECORD_SCHEMA)
    parts = files.mapInArrow(lambda b: tidy(_parse(b, True)), RECORD_SCHEMA)
    first = F.col("seg") == 1
    pick = lambda c: F.max(F.when(first, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        pick("record_type"), pick("key"), pick("refers_to"), pick("digest"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("seg", "block"))).alias("parts"),
    )
    block = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    joined = joined.withColumn("block", block)
    complete = (
        (F.octet_length("block") == F.col("total")) & F.forall("parts", lambda x: x["block"].isNotNull()) & (F.get(F.col("parts"), F.lit(0))["seg"] == 1) & (F.get(F.col("parts"), F.size("parts") - 1)["seg"] == F.size("parts"))
    )
    joined = joined.select(F.col("origin").alias("record_id"), "record_type", "key", "refers_to", "digest", F.coalesce(complete, F.lit(False)).alias("complete"), "block")
    whole = whole.select("record_id", "record_type", "key", "refers_to", "digest", F.col("block").isNotNull().alias("complete"), "block")
    rows = whole.unionByName(joined.withColumn("block", F.when(F.col("complete"), F.col("block"))))
    schema = "record_id string, record_type string, key bigint, refers_to bigint, digest string, complete boolean, payload_bytes bigint, payload binary"
    return rows.mapInArrow(lambda b: tidy(_payloads(b)), schema)


def archive_table(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
