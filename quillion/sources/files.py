"""Readers of files and the sinks of a candidate store.

Files come in through ``binaryFile``, so any store works; parsers run in Arrow batches
and turn a failure into an ``error`` text instead of failing the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".pdf", ".docx", ".txt")
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252")
LEAST_CHARS = 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_txt(data: bytes) -> str:
    """The first encoding that fits."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def parse_docx(data: bytes) -> str:
    """Body order: a line for each paragraph, text box paragraph and table cell; too short counts as empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines: list[str] = []

    def text_of(p) -> str:
        return "".join(t.text or "" for t in p.iter(f"{_W}t"))

    def walk(node) -> None:
        for child in node:
            if child.tag == f"{_W}p":
                boxes = list(child.iter(f"{_W}txbxContent"))
                if boxes:
                    for box in boxes:
                        walk(box)
                else:
                    lines.append(text_of(child))
            elif child.tag == f"{_W}tbl":
                for cell in child.iter(f"{_W}tc"):
                    lines.append(" ".join(x for x in map(text_of, cell.iter(f"{_W}p")) if x))

    walk(body)
    text = "\n".join(x for x in lines if x.strip())
    return text if len(text.strip()) >= LEAST_CHARS else ""


#: Parsers by extension; a PDF or OCR provider is put in by the caller.
PARSERS: dict[str, Callable[[bytes], str]] = {".txt": parse_txt, ".docx": parse_docx}


def _parse(batches: Iterator[pa.RecordBatch], parsers: dict[str, Callable[[bytes], str]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind = "." + path.rpartition(".")[2].lower()
            try:
                out.append((parsers[kind](data), None) if kind in parsers else (None, f"no parser for {kind}"))
            except Exception as e:  # a broken file is a row with an error
                out.append((None, f"{type(e).__name__}: {e}"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["path", "text", "error"])


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """One row per file below a folder: path, text, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    use = {**PARSERS, **(parsers or {})}
    return files.mapInArrow(lambda b: _parse(b, use), "path string, text string, error string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line breaks, under an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that does not parse is kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def save_store(rows: DataFrame, path: str) -> None:
    """Write the store to a new version beside the old one; readers take the newest complete one."""
    version = rows.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    rows.write.parquet(f"{path}/v={version}")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the store that was written whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().toString() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(names))


def export_rows(rows: DataFrame, arrays: list[str], mark: str = "; ") -> DataFrame:
    """Arrays flattened to delimited strings, for CSV."""
    return rows.select(*[F.array_join(F.filter(c, lambda x: x != ""), mark).alias(c) if c in arrays else F.col(c) for c in rows.columns])
