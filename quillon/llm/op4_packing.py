"""Best-fit packing, planned over the histogram of lengths.

No length is over the capacity, so the histogram has at most ``capacity`` entries however large the
corpus is. The driver runs best-fit decreasing over counts: equal lengths are placed many at a time
into runs of equal bins, which gives *slots* (a length, a range of ranks, and where they go). A
document then finds its slot by its rank among the documents of its length. Ranks are counted in
salted parts of each length, so a length that a third of all documents share is no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.llm import kernel as K
from quillon.llm import tokens
from quillon.llm.shared import written

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "__length long, __from long, __to long, __each long, __sequence long, __offset long"
#: Rows of one length that one task ranks, about.
RANKED_TOGETHER = 500_000


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing: (length, first rank, last rank + 1, how many in each bin, first bin, offset).

    Rank r of a slot goes to bin ``first bin + (r - first rank) // each``, at
    ``offset + (r - first rank) % each * length``. Bins are numbered from 0 without gaps.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first bin, bins)
    bins, slots = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, length
        while left:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:
                each = capacity // length
                count, space = -(-left // each), capacity
                room[capacity].append((bins, count))
                bins += count
            first, count = room[space].pop()
            each = space // length
            use = min(count, left // each)
            if not use:  # fewer left than one bin takes
                use, each = 1, left
            if count > use:
                room[space].append((first + use, count - use))
            slots.append((length, rank, rank + use * each, each, first, capacity - space))
            room[space - each * length].append((first, use))
            rank, left = rank + use * each, left - use * each
            space = length
    return slots


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``. ``pieces`` is read several times: give a table.

    Sequences are filled from 0 without gaps. Rows that agree in ``order`` are told apart by nothing,
    and each gets a place of its own. Lengths must be from 1 to ``capacity``; null or other lengths
    raise. Columns already named sequence_id or offset are replaced, others pass through; names that
    begin with ``__`` are reserved. An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r["n"] for r in pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in histogram:
        raise ValueError("a length is null")
    slots = spark.createDataFrame(plan_slots(histogram, capacity), SLOTS)
    salts = max(16, -(-sum(histogram.values()) // RANKED_TOGETHER))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    parts = (
        salted.groupBy(F.col(length).cast("long").alias("__length"), F.col("__salt").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("__length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("__length", "__part", "__before")
    )
    local = F.row_number().over(W.partitionBy(length, "__salt").orderBy(*order)) - 1
    ranked = salted.withColumn("__local", local).join(parts, (F.col(length) == F.col("__length")) & (F.col("__salt") == F.col("__part")))
    ranked = ranked.withColumn("__rank", F.col("__local") + F.col("__before")).drop("__length", "__part", "__before", "__local", "__salt")
    # at most about capacity ** 2 slots, whatever the number of rows
    placed = ranked.join(F.broadcast(slots), (F.col(length) == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    within = F.col("__rank") - F.col("__from")
    return placed.select(
        *(c for c in pieces.columns if c not in ("sequence_id", "offset")),
        (F.col("__sequence") + F.floor(within / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + within % F.col("__each") * F.col("__length")).cast("long").alias("offset"),
    )


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity``; only a first piece is shorter.

    Null and empty texts are one piece of the end id. With ``with_ids`` the ids come as a column. Only the
    two named columns are read; null and repeated keys are kept as they are, a row's pieces each.
    """
    path = tokenizer or tokens.default_path()
    schema = T._parse_datatype_string(PIECES + ", ids array<int>" * with_ids)
    kind = docs.schema[key].dataType
    schema.fields[0].dataType, schema.fields[0].name = kind, key

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, ids, bounds in tokens.encode_column(batch.column(1), path):
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.concatenate([np.arange(p) for p in pieces.tolist()]) if len(n) else row
                head = (n - (pieces - 1) * capacity)[row]
                start = np.where(number > 0, head + (number - 1) * capacity, 0)
                length = np.where(number > 0, capacity, head)
                at = bounds[:-1][row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [keys.take(pa.array(row + first)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate((at, bounds[-1:])), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            K.trim()

    return docs.select(key, text).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places; tokenised once, into a table in the shared folder."""
    return pack(written(token_pieces(docs, tokenizer=tokenizer, capacity=capacity), "pieces"), capacity=capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
