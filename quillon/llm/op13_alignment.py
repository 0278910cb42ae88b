"""Alignment of two tokenizers' tokens by a sweep over their end events.

A byte-level BPE (A) and a sentence-piece model with byte fallback (B) cut the same bytes, a space and the
text, into tokens. The offsets where a token ends are events. Both sides' events are united, dealt by
document, sorted by offset within partitions and swept once: where both sides end a group closes, and
between two neighbouring events one A and one B token overlap, which is a link. What the sweep holds is
the open group and a few runs of events, however long a document is.

Events travel in runs of ids of one side with the offset that the run starts at, as ends follow from the ids.
Links leave the sweep as distinct id pairs of a document with their number. How many documents have a
pair, and how that sums up for a document, are DataFrame operations: pairs that many documents have are
joined by broadcast, up to ``FREQUENT`` of them, all others by a shuffle, in which no key is hot.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernel as K
from quillon.llm import tokens
from quillon.llm.shared import new_folder, written

A, B = 0, 1
#: Tokens in one run of events, and in what the sweep takes at once.
RUN, SWEPT = 4096, 1 << 17
#: Id pairs whose counts are broadcast at most (some 60 bytes each).
FREQUENT = 1 << 20
#: Bytes of distinct units that a worker remembers.
_REMEMBERED = 48 << 20


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Table:
    """Bytes of each token id of a vocabulary."""

    def __init__(self, values: list[bytes]):
        self.size = np.fromiter(map(len, values), np.int64, len(values))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[K.ragged(self.start[ids], self.size[ids])]


@lru_cache(maxsize=1)
def byte_table(path: str) -> Table:
    """A's tokens: each character of the vocabulary's strings stands for a byte."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = {c: i for i, c in enumerate(tokens._byte_chars())}
    values = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        values[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Table(values)


@lru_cache(maxsize=1)
def piece_table(path: str) -> Table:
    """B's tokens: pieces with U+2581 as a space, and pieces of single bytes."""
    model = _pieces(path)
    return Table([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]])


class PieceEncoder:
    """Ids of texts by a sentence-piece model, as the library gives them.

    No piece has a space after another character, so nothing merges from a word into the space after
    it. Texts fall into units, spaces and what follows up to the next space, and the library sees
    each distinct unit once for each worker.
    """

    def __init__(self, path: str):
        self._model = _pieces(path)
        if any("▁" in self._model.id_to_piece(i).lstrip("▁") for i in range(self._model.get_piece_size())):
            raise ValueError("a piece of the model has a space inside, so texts can't be cut at spaces")
        self._space = self._model.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self._hashes, self._number = np.empty(0, K.U64), np.empty(0, np.int64)
        self._start, self._size, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Numbers of distinct units, given in order of their hashes; new ones are encoded."""
        at = np.searchsorted(self._hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self._hashes))
        known[inside] = self._hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            # the library puts a space of its own first
            units = [raw[a + 1 : b].decode() for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)]
            found = [ids if unit else [self._space] for unit, ids in zip(units, self._model.encode(units, num_threads=1), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            numbers = len(self._start) + np.arange(len(new))
            self._start = np.concatenate((self._start, len(self._ids) + np.cumsum(sizes) - sizes))
            self._size = np.concatenate((self._size, sizes))
            self._ids = np.concatenate((self._ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))))
            self._hashes, self._number = np.insert(self._hashes, at[new], hashes[new]), np.insert(self._number, at[new], numbers)
            at = np.searchsorted(self._hashes, hashes)
        return self._number[at]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the rows of a buffer, each of which begins with a space, and the bounds of each row among them."""
        if 32 * len(self._hashes) + 4 * len(self._ids) > _REMEMBERED:
            self._forget()
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts = data == 32
        starts[1:] &= data[:-1] != 32
        starts[bounds[:-1][bounds[:-1] < len(data)]] = True
        first = np.flatnonzero(starts)
        end = np.concatenate((first[1:], [len(data)]))
        distinct, index, inverse = np.unique(K.Spans(data).hash(first, end), return_index=True, return_inverse=True)
        number = self._numbers(distinct, first[index], end[index], data)[inverse.reshape(-1)]
        size = self._size[number]
        total = np.concatenate(([0], np.cumsum(size)))
        return self._ids[K.ragged(self._start[number], size)], total[np.searchsorted(first, bounds)]


@lru_cache(maxsize=1)
def _piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _wrong(table: Table, ids: np.ndarray, cut: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows' tokens don't join to their bytes?"""
    total = np.concatenate(([0], np.cumsum(table.size[ids])))[cut]
    wrong = np.diff(total) != np.diff(bounds)
    if not wrong.any():
        differs = np.flatnonzero(table.joined(ids) != data)
        wrong[np.searchsorted(bounds, differs, side="right") - 1] = True
        return wrong
    for r in np.flatnonzero(~wrong).tolist():
        wrong[r] = not np.array_equal(table.joined(ids[cut[r] : cut[r + 1]]), data[bounds[r] : bounds[r + 1]])
    return wrong


def _kinds(a_path: str, b_path: str) -> tuple[str, str]:
    return tuple("<u2" if len(t.size) <= 1 << 16 else "<u4" for t in (byte_table(a_path), piece_table(b_path)))


def _events(a_path: str, b_path: str):
    """Arrow batches (row, key, text) to runs (row, key, side, start, ids); a text without tokens is an empty run."""

    def runs(row: int, side: int, ids: np.ndarray, base: int, table: Table, kind: str) -> Iterator[tuple[int, int, int, bytes]]:
        for a in range(0, len(ids), RUN):
            part = ids[a : a + RUN]
            yield row, side, base, K.pack(part.astype(kind))
            base += int(table.size[part].sum())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (tokens.encoder(a_path, True), byte_table(a_path)), (_piece_encoder(b_path), piece_table(b_path))
        kinds = _kinds(a_path, b_path)
        for batch in batches:
            rows, keys = batch.column(0), batch.column(1)
            data, start, end = K.utf8(batch.column(2))
            for i, j in K.blocks(start, end):
                out = []
                buffer, bounds = K.gather(data, start[i:j], end[i:j])
                if j == i + 1 and len(buffer) > 2 * K.BLOCK_BYTES:
                    found, base = [], 0
                    cuts = tokens._pieces(buffer, K.BLOCK_BYTES)
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        part = buffer[a:b] if a else np.insert(buffer[:b], 0, np.uint8(32))
                        whole = np.array([0, len(part)])
                        for side, (encoder, table) in enumerate(sides):
                            ids, cut = encoder.encode(part, whole)
                            if found is not None and _wrong(table, ids, cut, part, whole)[0]:
                                found = None
                            if found is not None:
                                found += runs(i, side, ids, base, table, kinds[side])
                        base += len(part)
                    out = found or [(i, A, 0, b"")]
                else:
                    filled = np.flatnonzero(np.diff(bounds))
                    buffer = np.insert(buffer, bounds[:-1][filled], np.uint8(32))
                    size = np.diff(bounds) + (np.diff(bounds) > 0)
                    bounds = np.concatenate(([0], np.cumsum(size)))
                    coded = [encoder.encode(buffer, bounds) for encoder, _ in sides]
                    wrong = size == 0
                    for (ids, cut), (_, table) in zip(coded, sides, strict=True):
                        wrong |= _wrong(table, ids, cut, buffer, bounds)
                    for r in range(j - i):
                        if wrong[r]:
                            out.append((i + r, A, 0, b""))
                            continue
                        for side, (ids, cut) in enumerate(coded):
                            out += runs(i + r, side, ids[cut[r] : cut[r + 1]], 0, sides[side][1], kinds[side])
                if out:
                    row, side, begin, packed = zip(*out, strict=True)
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.take(take), keys.take(take), pa.array(side, pa.int32()), pa.array(begin, pa.int64()), pa.array(packed, pa.binary())], names=["row", "key", "side", "start", "ids"])

    return encode


@lru_cache(maxsize=2)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each number up to ``most``, left-bound, and how many there are."""
    texts = [str(i).encode() for i in range(most + 1)]
    width = len(texts[-1])
    return np.frombuffer(b"".join(t.ljust(width + 1) for t in texts), np.uint8).reshape(most + 1, width + 1), np.fromiter(map(len, texts), np.int64, most + 1)


class Swept:
    """Groups and links of documents that lie one after another; both sides' ids have the same bytes."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], bounds: tuple[np.ndarray, np.ndarray], tables: tuple[Table, Table]):
        ends = [np.cumsum(t.size[i]) for i, t in zip(ids, tables, strict=True)]
        n = int(ends[A][-1]) + 1 if len(ids[A]) else 1
        marks = np.zeros((2, n), bool)
        marks[A][ends[A]] = marks[B][ends[B]] = True
        marks[:, 0] = False
        counts = np.cumsum(marks, axis=1, dtype=np.int32)
        both = marks[A] & marks[B]
        last = np.concatenate(([0], ends[A]))[bounds[A]]  # bytes up to each document's end
        at = np.flatnonzero(marks[A] | marks[B])
        self.tokens = [np.diff(b) for b in bounds]
        self.groups = np.diff(np.cumsum(both)[last])
        self.links = np.diff(np.searchsorted(at, last, side="right"))
        self._pairs(ids, [counts[s][at] - marks[s][at] for s in (A, B)], tables)
        self._text(ids, bounds, [counts[s][np.flatnonzero(both)].astype(np.int64) for s in (A, B)], tables)

    def _pairs(self, ids, linked, tables) -> None:
        bits = [int(len(t.size)).bit_length() for t in tables]
        if sum(bits) + int(len(self.links)).bit_length() > 64:
            raise ValueError("the vocabularies are too large")
        document = np.repeat(np.arange(len(self.links), dtype=K.U64), self.links)
        key = (document << K.U64(sum(bits))) | (ids[A][linked[A]].astype(K.U64) << K.U64(bits[B])) | ids[B][linked[B]].astype(K.U64)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        distinct = key[first]
        self.number = np.diff(np.concatenate((first, [len(key)])))
        self.a = (distinct >> K.U64(bits[B]) & K.U64((1 << bits[A]) - 1)).astype(np.int32)
        self.b = (distinct & K.U64((1 << bits[B]) - 1)).astype(np.int32)
        self.pair_bounds = np.searchsorted(distinct >> K.U64(sum(bits)), np.arange(len(self.links) + 1, dtype=K.U64))

    def _text(self, ids, bounds, through, tables) -> None:
        """``a1,a2|b1;`` for each group, all in one buffer."""
        before = [np.concatenate(([0], t[:-1])) if len(t) else t for t in through]
        total = len(ids[A]) + len(ids[B])
        at_a = np.arange(len(ids[A])) + np.repeat(before[B], through[A] - before[A])
        at_b = np.arange(len(ids[B])) + np.repeat(through[A], through[B] - before[B])
        merged, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        merged[at_a], merged[at_b] = ids[A], ids[B]
        mark[at_a[through[A] - 1]], mark[through[A] + through[B] - 1] = ord("|"), ord(";")
        digits, width = _digits(max(len(t.size) for t in tables))
        cells, own = digits[merged], width[merged]
        cells[np.arange(total), own] = mark
        self.text = cells[np.arange(cells.shape[1]) <= own[:, None]]
        self.text_bounds = np.concatenate(([0], np.cumsum(own + 1)))[bounds[A] + bounds[B]]


class _Sweep:
    """Runs of events in order of (row, start, side) to rows of documents, or of parts of long ones."""

    def __init__(self, tables: tuple[Table, Table], kinds: tuple[str, str]):
        self._tables, self._kinds = tables, kinds
        self._row, self._key = None, None
        self._done: list[tuple] = []
        self._small: list[tuple] = []  # whole documents that are swept together
        self._held = 0

    def _begin(self, row: int, key) -> None:
        self._row, self._key, self._open, self._size, self._hash, self._last = row, key, ([], []), 0, None, None

    def add(self, row: int, key, side: int, packed: bytes) -> None:
        if row != self._row:
            self.close()
            self._begin(row, key)
        if packed:
            ids = K.unpack(packed, self._kinds[side])[0].astype(np.int64)
            self._open[side].append(ids)
            self._size += len(ids)
            if self._size > SWEPT:
                self._sweep_part()

    def _joined(self) -> list[np.ndarray]:
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in self._open]

    def _sweep_part(self) -> None:
        """Sweep up to the last offset where both sides end; the open group stays."""
        ids = self._joined()
        ends = [np.cumsum(t.size[i]) for i, t in zip(ids, self._tables, strict=True)]
        both = np.intersect1d(*ends, assume_unique=True)
        self._open = tuple([i] for i in ids)
        if len(both):
            cut = [int(np.searchsorted(e, both[-1], side="right")) for e in ends]
            self._emit_part([i[:c] for i, c in zip(ids, cut, strict=True)])
            self._open = tuple([i[c:]] for i, c in zip(ids, cut, strict=True))
            self._size = sum(len(i) - c for i, c in zip(ids, cut, strict=True))

    def _emit_part(self, ids: list[np.ndarray]) -> None:
        swept = Swept(tuple(ids), tuple(np.array([0, len(i)]) for i in ids), self._tables)
        if self._hash is None:
            self._hash = hashlib.sha256()
        else:
            self._hash.update(b";")
            self._done.append(self._last)
        self._hash.update(swept.text[:-1])
        self._last = self._row_of(swept, 0, self._row, self._key, False, None)  # waits, as the document's hash goes with the last one

    @staticmethod
    def _row_of(swept: Swept, i: int, row: int, key, whole: bool, sha: str | None) -> tuple:
        a, b = swept.pair_bounds[i], swept.pair_bounds[i + 1]
        return row, key, whole, int(swept.tokens[A][i]), int(swept.tokens[B][i]), int(swept.groups[i]), int(swept.links[i]), sha, (swept.a[a:b], swept.b[a:b], swept.number[a:b])

    def close(self) -> None:
        if self._row is None:
            return
        ids = self._joined()
        if self._hash is None:
            self._small.append((self._row, self._key, ids))
            self._held += self._size
            if self._held > SWEPT:
                self._sweep_small()
        else:
            if len(ids[A]):
                self._emit_part(ids)
            self._done.append((*self._last[:7], self._hash.hexdigest(), self._last[8]))
        self._row = None

    def _sweep_small(self) -> None:
        if not self._small:
            return
        parts = [[ids[s] for _, _, ids in self._small] for s in (A, B)]
        bounds = tuple(np.concatenate(([0], np.cumsum([len(p) for p in side]))) for side in parts)
        swept = Swept(tuple(np.concatenate(side) for side in parts), bounds, self._tables)
        raw = memoryview(swept.text)
        for i, (row, key, ids) in enumerate(self._small):
            sha = hashlib.sha256(raw[swept.text_bounds[i] : swept.text_bounds[i + 1] - 1]).hexdigest() if len(ids[A]) else ""
            self._done.append(self._row_of(swept, i, row, key, True, sha))
        self._small, self._held = [], 0

    def finish(self) -> None:
        self.close()
        self._sweep_small()

    def taken(self) -> list[tuple]:
        done, self._done = self._done, []
        return done


_LINKS = "array<struct<a: int, b: int, number: int>>"


def _swept(key: pa.DataType, a_path: str, b_path: str):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        plain, links = list(zip(*(r[:8] for r in rows), strict=True)), [r[8] for r in rows]
        bounds = np.concatenate(([0], np.cumsum([len(x[0]) for x in links])))
        columns = [pa.array(np.concatenate([x[k] for x in links]).astype(np.int32)) for k in range(3)]
        nested = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["a", "b", "number"]))
        kinds = [pa.int64(), key, pa.bool_(), *[pa.int64()] * 4, pa.string()]
        names = ["row", "key", "whole", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds, strict=True)), nested], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sweep((byte_table(a_path), piece_table(b_path)), _kinds(a_path, b_path))
        for batch in batches:
            columns = [batch.column(c) for c in ("row", "key", "side", "ids")]
            for i in range(0, batch.num_rows, 256):
                for row, k, side, packed in zip(*(c.slice(i, 256).to_pylist() for c in columns), strict=True):
                    own.add(row, k, side, packed)
                done = own.taken()
                if done:
                    yield table(done)
        own.finish()
        done = own.taken()
        if done:
            yield table(done)

    return sweep


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Groups and links of each document, as a table of the shared folder.

    Returns row (a number for each row of ``docs``), key, whole, n_a, n_b, n_groups, n_links, groups_sha256 and links
    (distinct id pairs with their number). A document of over ``SWEPT`` tokens is several rows that aren't
    ``whole``: their counts add up, the last has the hash. Null and empty texts, and texts whose tokens
    don't join to a space and the text, have no tokens: zeros and an empty hash. Only the two columns are read;
    null and repeated keys are rows of their own. An empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    paths = a_path or tokens.default_path(), b_path or piece_path()
    kind = docs.schema[key].dataType
    own = kind.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    events = rows.mapInArrow(_events(*paths), f"row long, key {own}, side int, start long, ids binary")
    ordered = events.repartition("row").sortWithinPartitions("row", "start", "side")
    schema = f"row long, key {own}, whole boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {_LINKS}"
    swept = ordered.mapInArrow(_swept(to_arrow_type(kind), *paths), schema)
    path = new_folder(spark, "aligned")
    swept.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(swept.schema).parquet(path)


def document_links(aligned: DataFrame) -> DataFrame:
    """(row, a, b, number): each id pair of each document once."""
    links = lambda rows: rows.select("row", F.inline("links"))
    parts = links(aligned.where("NOT whole")).groupBy("row", "a", "b").agg(F.sum("number").cast("int").alias("number"))
    return links(aligned.where("whole")).unionByName(parts)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents have an id pair, and is that the highest number of its A id?"""
    counts = written(document_links(aligned).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    # a row for each A id: as many as the vocabulary has at most
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of documents with links."""
    links = document_links(aligned)
    # pairs by the power of two of their count: at most 64 rows
    by_power = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    power, room = max(by_power, default=0) + 1, frequent
    while power > 0 and by_power.get(power - 1, 0) <= room:
        power -= 1
        room -= by_power.get(power, 0)
    usual = F.broadcast(counts.where(F.floor(F.log2("n")) >= power))
    found = links.join(usual, ["a", "b"])
    if power > 0:
        # what few documents have: no pair of these has many rows
        rest = links.join(usual.select("a", "b"), ["a", "b"], "left_anti")
        found = found.unionByName(rest.join(counts.where(F.floor(F.log2("n")) < power), ["a", "b"]))
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("number")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("number").cast("long") * F.col("n")).alias("count_sum"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. One of two texts with one doc_id stays a row of its own."""
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    marks = scored(aligned, pair_counts(aligned))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    whole = aligned.where("whole").select("row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    parts = aligned.where("NOT whole").groupBy("row").agg(F.any_value("key").alias("key"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    out = whole.unionByName(parts).join(marks, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
