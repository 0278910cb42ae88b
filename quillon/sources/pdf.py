"""PDF files as a source: whether a file is one, and the texts of its pages.

Reads what simple writers produce: pages in order of their objects, streams plain or deflated, texts
shown by Tj, ', " and TJ with one-byte characters. Fonts with encodings of their own are not decoded. Files that
it can't read, as they are encrypted, keep objects in streams or have no pages, are told apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|\bTj\b|\bTJ\b|\bT\*|\bTd\b|\bTD\b|\bET\b|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def is_pdf(content: Column, content_type: Column | None = None) -> Column:
    """By its first bytes, or by what its sender says of it."""
    magic = F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return magic if content_type is None else magic | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))


def _literal(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return plain.decode("cp1252", "replace")


def _shown(stream: bytes) -> str:
    out: list[str] = []
    for m in _SHOWN.finditer(stream):
        token = m[0]
        if token[:1] == b"(":
            out.append(_literal(token))
        elif token in (b"T*", b"Td", b"TD", b"ET", b"'", b'"') and out and out[-1] != "\n":
            out.append("\n")
    return "".join(out).strip("\n")


def page_texts(content: bytes) -> list[str]:
    """Texts of the pages; empty for a file that isn't one, that is damaged, or that this can't read."""
    if re.search(rb"/Type\s*/ObjStm\b|/Encrypt\b", content or b""):
        return []
    objects = {int(n): body for n, body in _OBJECT.findall(content or b"")}

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        m = _STREAM.search(body)
        if m is None:
            return b""
        try:
            return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]
        except zlib.error:
            return b""

    pages = [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    return ["\n".join(filter(None, (_shown(stream(int(n))) for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page) or [b"", b""])[1])))) for page in pages]


def pdf_pages(spark: SparkSession, folder: str, pattern: str = "*.pdf", least_bytes: int = 0) -> DataFrame:
    """(name, page from 0, text) of the PDF files of a folder; one row with a null page for a file that can't be read.

    A folder with a level for each exam (``exam=7/a.pdf``) is pruned by filters on that column before files
    are opened, so it comes as a column too. A task holds one file at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).where(F.col("length") > least_bytes)
    levels = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    files = files.select(*levels, F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(is_pdf(F.col("content")))
    given = len(levels) + 1
    names = [*levels, "name", "page", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(given)):
                texts = page_texts(content.as_py())
                pages = pa.array(range(len(texts)) if texts else [None], pa.int64())
                own = [batch.column(k).take(pa.array([i] * len(pages))) for k in range(given)]
                yield pa.RecordBatch.from_arrays([*own, pages, pa.array(texts or [None], pa.string())], names=names)

    return files.mapInArrow(run, T.StructType([*files.schema.fields[:given], T.StructField("page", T.LongType()), T.StructField("text", T.StringType())]))
