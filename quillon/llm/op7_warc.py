"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id, payload digest and URL. Narrow rows (sort key, bytes) are sorted
first; a running sum of bytes cuts them into shards, so the shards depend on the pages alone, whatever
the cluster does and however ids are spread, and each shard is one task's. A task regenerates headers
and digests, compresses each record as a gzip member of its own and rolls files by compressed size.
Files appear through temporary names and a manifest (see ``filesink``).

Of records with equal payloads the one with the largest page id is a response and the others are
revisits that refer to it; copies are found on (digest, id) rows alone, never with the payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import filesink
from quillon.llm.shared import new_folder, written

#: Payload bytes to a shard and compressed bytes to a file, about. A task holds neither, but one record.
#: Of very large tables shards are larger, so that there are at most so many (their bounds are broadcast).
SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 32 << 20, 16 << 20, 100_000
#: Sort keys (about 64 bytes each) to a task.
SORTED_TOGETHER = 1_000_000
#: Payloads with more copies than this are joined by broadcast, as one key could be most rows.
HOT_COPIES = 100_000
#: Bytes of a record besides its payload, about.
_HEADERS = 512
#: Copies of payloads of at least so many bytes are revisits.
LEAST_REVISIT = 0
#: Of compression; higher ones take twice the time for some per cent of size.
LEVEL = 4
#: Pages carry no time; headers need one, and the same input has to give the same files.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header of its payload, and no payload."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    target = re.sub(r"[\x00-\x20]+", "%20", url) if url else _urn(page)[1:-1]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip header without name or time
    return gz.compress(raw) + gz.flush()


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a compressed file; one record is held."""
    rest = file.read(1 << 16)
    while rest:
        gz, parts = zlib.decompressobj(31), []
        while True:
            parts.append(gz.decompress(rest))
            if gz.eof:
                break
            rest = file.read(1 << 16)
            if not rest:
                raise ValueError("a record is cut off")
        rest = gz.unused_data or file.read(1 << 16)
        text = b"".join(parts)
        head, _, body = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if body[size:] != b"\r\n\r\n":
            raise ValueError("a record has the wrong length")
        yield fields, body[:size]


def _sort_key(page: Column, digest: Column, last: Column) -> Column:
    """Bytes that sort as (page, nulls first; digest; last)."""
    number = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    flipped = F.coalesce(page, F.lit(0).cast("long")).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.unhex(F.when(page.isNull(), "00").otherwise("01")), number(flipped), F.unhex(digest), last)


_KEY_BYTES = 1 + 8 + 20 + 8 + 8
_NUMBERED_TOGETHER = 4096


def _shards(narrow: DataFrame, shard_bytes: int, most_shards: int) -> tuple[DataFrame, list[bytes]]:
    """The rows (key, bytes, ...) with their shard, and the first key of each shard after the first one."""
    size = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    if not size["n"]:
        return narrow.withColumn("shard", F.lit(0).cast("long")), []
    each = max(shard_bytes, -(-size["b"] // most_shards))
    runs = max(1, -(-size["n"] // SORTED_TOGETHER))
    ordered = written(narrow.repartitionByRange(runs, "key").withColumn("run", F.spark_partition_id()), "keys")
    sums = ordered.groupBy("run").agg(F.sum("bytes").alias("n"))
    # one row for each million pages meets in one task
    earlier = sums.select(F.col("run").alias("r"), F.coalesce(F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("run").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.withColumn("inside", before).join(earlier, F.col("run") == F.col("r"))
    placed = written(placed.select(*narrow.columns, F.floor((F.col("earlier") + F.col("inside")) / F.lit(each)).cast("long").alias("number")), "placed")
    firsts = placed.groupBy("number").agg(F.min("key").alias("first")).orderBy("number").collect()  # at most ``most_shards``
    numbers = [r["number"] for r in firsts]  # a record larger than a shard leaves numbers out
    shards = placed.sparkSession.createDataFrame(list(zip(numbers, range(len(numbers)), strict=True)), "number long, shard long")
    return placed.join(F.broadcast(shards), "number").drop("number"), [bytes(r["first"]) for r in firsts[1:]]


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_revisit: int = LEAST_REVISIT, most_shards: int = MOST_SHARDS, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Write one record for each row; returns the manifest.

    Null html is an empty payload, a null url becomes the record's own URN, null ids stand first and
    only refer, unless no copy has an id: then all are responses. Rows that share the largest id
    and payload are all responses; repeated rows are a record each. A record larger than a file or a
    shard is one of its own. Only the three named columns are read. An empty table gives a manifest
    without files.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # rows that agree in everything are dealt apart by where they stand; which of them goes where makes no difference
    last = F.concat(F.unhex(F.lpad(F.hex(F.xxhash64("url")), 16, "0")), F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
    base = base.withColumn("key", _sort_key(F.col("page"), F.col("digest"), last))
    narrow, cuts = _shards(base.select("key", "page", "digest", F.octet_length("html").alias("size"), (F.octet_length("html") + F.lit(_HEADERS)).cast("long").alias("bytes")), shard_bytes, most_shards)
    rows = narrow.where(F.col("size") >= least_revisit).select("page", "digest")
    kept = rows.groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    kept = written(kept, "kept").withColumnRenamed("digest", "d")
    hot = F.broadcast(kept.where(F.col("n") > hot_copies))  # at most rows / hot_copies of them
    cold = rows.join(hot, F.col("digest") == F.col("d"), "left_anti").join(kept.where(F.col("n") <= hot_copies), F.col("digest") == F.col("d"))
    referring = cold.unionByName(rows.join(hot, F.col("digest") == F.col("d"))).where(~F.col("page").eqNullSafe(F.col("keeper"))).select("page", "digest", "keeper").distinct()
    bounds = spark.sparkContext.broadcast(np.array(cuts, f"S{_KEY_BYTES}"))

    @F.pandas_udf("long")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, np.array(keys.tolist(), f"S{_KEY_BYTES}"), side="right"))

    # what a page refers to travels to its shards as a row of its own, just before the page: payloads move once
    pages_rows = base.select(shard_of("key").alias("shard"), "key", "page", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("keeper"))
    # to all shards where rows of the page and payload may stand, so it doesn't matter if equal rows are dealt otherwise when they are read again
    first, past = (_sort_key(F.col("page"), F.col("digest"), F.lit(x)) for x in (b"", b"\xff" * 16))
    places = referring.select("*", first.alias("key"), shard_of(first).alias("low"), shard_of(past).alias("high"))
    notes = places.select(F.explode(F.sequence("low", "high")).alias("shard"), "key", "page", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "keeper")
    ordered = pages_rows.unionByName(notes).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("key", "kind").drop("key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, part, count, raw_size, now = None, 0, 0, 0, 0
        refers = (None, None, None)

        def closed() -> pa.RecordBatch:
            sink.close()
            return filesink.task_row(now, part, sink.name, sink.bytes, count, raw_size)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # Python objects for few rows at once
                few = batch.slice(k, 256)
                for s, page, digest, kind, address, text, keeper in zip(*(few.column(i).to_pylist() for i in range(7)), strict=True):
                    if not kind:
                        refers = (page, digest, keeper)
                        continue
                    keeper = refers[2] if refers[:2] == (page, digest) else None
                    if sink is not None and sink.bytes >= file_bytes:
                        yield closed()
                        sink, part, count, raw_size = None, part + 1, 0, 0
                    if sink is None:
                        sink, now = filesink.Sink(folder), s
                    raw = record(page, address, text.encode(), keeper, keeper is not None)
                    sink.write(_member(raw))
                    count += 1
                    raw_size += len(raw)
        if sink is not None:
            yield closed()

    return filesink.commit(spark, folder, ordered.mapInArrow(write, filesink.TASK_SCHEMA), "warc.gz")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each record, read from the files; digests and lengths are verified."""
    schema = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [f.partition(" ")[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def page_of(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def parsed(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        digest, response = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
        if response and (len(payload) != length or sha1_base32(payload) != digest):
            raise ValueError(f"{fields['warc-record-id']}: the payload is damaged")
        if sha1_base32(block) != fields["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"{fields['warc-record-id']}: the block is damaged")
        return page_of(fields["warc-record-id"]), fields["warc-target-uri"], length, digest, fields["warc-type"], page_of(fields.get("warc-refers-to")), payload if response else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesink.source(folder, name) as file:
                    rows, held = [], 0
                    for fields, block in records(file):
                        rows.append(parsed(fields, block))
                        held += len(block)
                        if len(rows) == 1000 or held >= 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    return filesink.each_file(manifest).select("name").mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
