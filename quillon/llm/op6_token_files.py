"""Token-ID files: patched frame-of-reference blocks behind an index of block starts.

A block holds up to 512 ids: the block's minimum is subtracted, the low bits are packed at a width
that a percentile of the block fits into, and what doesn't fit stands in an exception list (place and
high bits). A file is: magic, blocks, index of documents (keys, sizes), index of block starts, counts;
so blocks leave as they fill, and any ids are read through the index of block starts. Files are
independent shards in ascending document order; the manifest has how many ids stand before each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel as K
from quillon.llm import filesink, tokens
from quillon.llm.shared import new_folder, text_bytes

MAGIC = b"PFOR0002"
BLOCK = 512
PERCENTILE = 95
#: Text bytes to a shard, about, and ids to a file at most (but for one longer document). Tasks hold
#: neither whole. Of very large tables shards are larger, so that there are at most so many of them.
SHARD_BYTES, FILE_IDS, MOST_SHARDS = 24 << 20, 16 << 20, 100_000
#: Blocks that are packed or read at once.
RUN = 256
_TAIL = struct.Struct("<IIQQQ8s")  # block size, unused, ids, blocks, documents, magic
_BLOCK = struct.Struct("<IBxHH")  # minimum, width, ids, exceptions (of 10 bytes)
_BITS = np.array([int(x).bit_length() for x in range(1 << 16)], np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 16
    return np.where(high > 0, 16 + _BITS[high], _BITS[x & 0xFFFF]).astype(np.int64)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each at ``width`` bits, as rows of bytes."""
    if not width:
        return np.empty((len(values), 0), np.uint8)
    as_bytes = values.astype("<u4").reshape(len(values), -1, 1).view(np.uint8)[:, :, : -(-width // 8)]
    bits = np.unpackbits(as_bytes, axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack_bits(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), count), np.uint32)
    bits = np.unpackbits(rows, axis=1, bitorder="little", count=width * count).reshape(len(rows), count, width)
    out = np.zeros((len(rows), count, 4), np.uint8)
    out[:, :, : -(-width // 8)] = np.packbits(bits, axis=2, bitorder="little")
    return out.view("<u4")[:, :, 0]


def _packed(part: np.ndarray, percentile: float, block: int) -> list[bytes]:
    """Blocks of ids; all but the last are full."""
    n = -(-len(part) // block)
    full = np.full(n * block, part[-1], np.uint32)
    full[: len(part)] = part
    full = full.reshape(n, block)
    counts = np.full(n, block)
    counts[-1] = len(part) - (n - 1) * block
    least = full.min(axis=1)
    rest = full - least[:, None]
    at = int(min(block - 1, np.ceil(block * percentile / 100) - 1))
    width = _bit_length(np.partition(rest, at, axis=1)[:, at])
    low = rest & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    high = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype("<u4")
    body: dict[int, bytes] = {}
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        for i, row in zip(which.tolist(), _pack_bits(low[which], w), strict=True):
            body[i] = row.tobytes()
    out = []
    for i in range(n):
        c = int(counts[i])
        odd = np.flatnonzero(high[i, :c]).astype("<u2")
        out.append(_BLOCK.pack(int(least[i]), int(width[i]), c, len(odd)) + body[i] + odd.tobytes() + high[i, odd].tobytes())
    return out


class TokenWriter:
    """Writes one file. Blocks leave as they fill; only the two indexes are held until ``close``."""

    def __init__(self, sink, percentile: float = PERCENTILE, block: int = BLOCK):
        self._sink, self._percentile, self._block = sink, percentile, block
        self._keys: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []
        self._starts = [np.array([len(MAGIC)], "<u8")]
        self._at, self._open = len(MAGIC), np.empty(0, np.uint32)
        self.ids = self.documents = 0
        sink.write(MAGIC)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """More documents (key, number of ids) and all their ids."""
        self._keys.append(keys.astype("<i8"))
        self._sizes.append(sizes.astype("<u8"))
        self.documents += len(keys)
        self.ids += len(ids)
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, RUN * self._block - len(self._open))
            self._open = np.concatenate((self._open, ids[at : at + take]))
            at += take
            if len(self._open) == RUN * self._block:
                self._flush()

    def _flush(self) -> None:
        if len(self._open):
            found = _packed(self._open, self._percentile, self._block)
            ends = self._at + np.cumsum([len(x) for x in found])
            self._starts.append(ends.astype("<u8"))
            self._at = int(ends[-1])
            self._sink.write(b"".join(found))
            self._open = np.empty(0, np.uint32)

    def close(self) -> None:
        self._flush()
        starts = np.concatenate(self._starts)
        self._sink.write(np.concatenate([np.empty(0, "<i8"), *self._keys]).tobytes())
        self._sink.write(np.concatenate([np.empty(0, "<u8"), *self._sizes]).tobytes())
        self._sink.write(starts.tobytes())
        self._sink.write(_TAIL.pack(self._block, 0, self.ids, len(starts) - 1, self.documents, MAGIC))
        self._sink.close()


class TokenReader:
    """Reads ids of one file through its index of block starts; no more than the asked blocks are held."""

    def __init__(self, file):
        self._file = file
        file.seek(0, 2)
        size = file.tell()
        if size < len(MAGIC) + _TAIL.size:
            raise ValueError("not a token file")
        self.block, _, self.ids, n_blocks, n_docs, magic = _TAIL.unpack(self._range(size - _TAIL.size, size))
        if magic != MAGIC or self._range(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        at = size - _TAIL.size - 8 * (n_blocks + 1)
        self._starts = np.frombuffer(self._range(at, size - _TAIL.size), "<u8").astype(np.int64)
        raw = self._range(at - 16 * n_docs, at)
        self.keys = np.frombuffer(raw, "<i8", n_docs)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u8", n_docs, 8 * n_docs).astype(np.int64))))
        if self.bounds[-1] != self.ids:
            raise ValueError("the sizes of documents are wrong")

    def _range(self, a: int, b: int) -> bytes:
        self._file.seek(a)
        raw = self._file.read(b - a)
        if len(raw) != b - a:
            raise ValueError("a token file is cut off")
        return raw

    def read(self, a: int, b: int) -> np.ndarray:
        """ids a to b of the file: only the blocks that hold them are read."""
        if a >= b:
            return np.empty(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        starts = self._starts[i : j + 1]
        ids = _unpacked(self._range(int(starts[0]), int(starts[-1])), starts - starts[0], self.block)
        have = min(j * self.block, self.ids) - i * self.block
        if len(ids) != have:
            raise ValueError("a block count is wrong")
        return ids[a - i * self.block : b - i * self.block]

    def runs(self, run: int = RUN * BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
        """All ids in runs: place of the first one, place after the last one, ids."""
        for a in range(0, self.ids, run):
            yield a, min(a + run, self.ids), self.read(a, min(a + run, self.ids))


def _unpacked(raw: bytes, starts: np.ndarray, block: int) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8)
    first = starts[:-1]
    heads = body[first[:, None] + np.arange(_BLOCK.size)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4").reshape(-1)
    width = heads[:, 4].astype(np.int64)
    count = np.ascontiguousarray(heads[:, 6:8]).view("<u2").reshape(-1).astype(np.int64)
    odd = np.ascontiguousarray(heads[:, 8:10]).view("<u2").reshape(-1).astype(np.int64)
    ids = np.empty((len(first), block), np.uint32)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        rows = body[first[which][:, None] + _BLOCK.size + np.arange(-(-w * block // 8))]
        ids[which] = _unpack_bits(rows, w, block) + least[which][:, None]
    for i in np.flatnonzero(odd).tolist():
        p = int(first[i]) + _BLOCK.size + -(-int(width[i]) * block // 8)
        place = np.frombuffer(raw, "<u2", odd[i], p)
        ids[i, place] += (np.frombuffer(raw, "<u4", odd[i], p + 2 * int(odd[i])).astype(np.uint64) << np.uint64(width[i])).astype(np.uint32)
    return ids.reshape(-1)[: int(count.sum())]


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, shard_bytes: int = SHARD_BYTES, file_ids: int = FILE_IDS, most_shards: int = MOST_SHARDS) -> DataFrame:
    """Encode every text and write the files in ascending order of the key; returns the manifest.

    Null text: only the end id. Null keys are refused (the files hold integers). Equal keys stay
    side by side, in order of their texts' hash. Only the two named columns are read, so others may
    have any names. A document of more than ``file_ids`` ids is in one file still. An empty table
    gives a manifest without files.
    """
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    shards = min(most_shards, max(1, -(-text_bytes(docs, text) // shard_bytes)))
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = ordered.repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        sink = out = None

        def closed() -> pa.RecordBatch:
            out.close()
            return filesink.task_row(shard, part, sink.name, sink.bytes, out.documents, out.ids)

        for batch in batches:
            own = batch.column(0)
            if own.null_count:
                raise ValueError("a document has no key")
            own = np.asarray(own)
            for first, found, bounds in tokens.encode_column(batch.column(1), path):
                i, n = 0, len(bounds) - 1
                while i < n:
                    room = file_ids - (out.ids if out is not None else 0)
                    j = int(np.searchsorted(bounds, bounds[i] + room, side="right")) - 1
                    if j <= i and out is not None and out.ids:
                        yield closed()
                        out, part = None, part + 1
                        continue
                    if out is None:
                        sink = filesink.Sink(folder)
                        out = TokenWriter(sink)
                    j = min(max(j, i + 1), n)
                    out.add(own[first + i : first + j], np.diff(bounds[i : j + 1]), found[bounds[i] : bounds[j]])
                    i = j
        if out is not None:
            yield closed()

    return filesink.commit(spark, folder, ordered.mapInArrow(write, filesink.TASK_SCHEMA), "pfor")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 [, ids].

    A task reads its files by runs of blocks. With ``with_ids`` it holds one document's ids whole.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def rows(reader: TokenReader, before: int) -> Iterator[pa.RecordBatch]:
        bounds, n = reader.bounds, len(reader.keys)
        done, crc, body = 0, 0, []
        ends: list[int] = []
        crcs: list[int] = []
        lists: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            a, b = done - len(crcs), done
            columns = [pa.array(reader.keys[a:b], pa.int64()), pa.array(bounds[a:b] + before, pa.int64()), pa.array(np.diff(bounds[a : b + 1]), pa.int64()), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends))), pa.int32()), pa.array(np.concatenate(lists).astype(np.int32))))
            for x in (crcs, ends, lists):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

        for a, b, ids in reader.runs():
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            while done < n and bounds[done] <= b:
                low, high = max(int(bounds[done]), a), min(int(bounds[done + 1]), b)
                crc = zlib.crc32(raw[4 * (low - a) : 4 * (high - a)], crc)
                if with_ids:
                    body.append(ids[low - a : high - a])
                if high < bounds[done + 1]:
                    break  # goes on in the next run
                crcs.append(crc)
                if with_ids:
                    lists.append(np.concatenate(body))
                    ends.append(len(lists[-1]))
                done, crc, body = done + 1, 0, []
            if crcs:
                yield batch()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesink.source(folder, name) as file:
                    yield from rows(TokenReader(file), before)

    return filesink.each_file(manifest).select("name", "units_before").mapInArrow(read, schema)


def lookup_tokens(folder: str, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents with the given keys, each read through the index of its file.

    Every file is asked for the keys, whose list is broadcast: give few (a million at most is accepted).
    """
    wanted = [r[0] for r in keys.select(F.col(key).cast("long")).where(F.col(key).isNotNull()).distinct().limit(1_000_001).collect()]
    if len(wanted) > 1_000_000:
        raise ValueError("too many keys: join them with read_tokens")
    shared = manifest.sparkSession.sparkContext.broadcast(np.sort(np.array(wanted, np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with filesink.source(folder, name) as file:
                    reader = TokenReader(file)
                    for i in np.flatnonzero(np.isin(reader.keys, shared.value)).tolist():
                        ids = reader.read(int(reader.bounds[i]), int(reader.bounds[i + 1]))
                        yield pa.RecordBatch.from_arrays([pa.array(reader.keys[i : i + 1]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return filesink.each_file(manifest).select("name").mapInArrow(read, "doc_id long, ids array<int>")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder, manifest)
