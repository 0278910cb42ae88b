"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers from 0 in an order of their own content. A keyed permutation of the numbers is the
shuffle: its value modulo the number of shards is a row's shard, the quotient its slot there. So the
counts of shards differ by one at most, slots have no gaps, equal inputs give equal shards however they
are split into files, and both ways can be computed for any row without the table.

The permutation is a Feistel network over pairs (left, right) of about the square root of the number
of rows each. It permutes slightly more than the rows; a value beyond them is permuted again until it
falls among them (cycle walking), which keeps it a permutation of the rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.kernel import mix64
from quillon.llm.ordered import in_order

SHARDS, SEED, ROUNDS = 16, 12, 8
_STEP = 0x9E3779B97F4A7C15


class Feistel:
    """A permutation of the numbers from 0 to ``n`` - 1, chosen by ``seed``. ``n`` is at least 1."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if n < 1 or rounds < 1:
            raise ValueError("a permutation needs a number and a round")
        self.n, self.left = n, math.isqrt(n - 1) + 1
        self.right = -(-n // self.left)
        # one 64-bit key for each round
        self.keys = [int(k) for k in mix64(np.array([(seed * 1_000_003 + i + 1) * _STEP % (1 << 64) for i in range(rounds)], np.uint64))]

    def _shift(self, half: np.ndarray, key: int, size: int) -> np.ndarray:
        return (mix64(half + np.uint64(key)) % np.uint64(size)).astype(np.uint64)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        sizes = (np.uint64(self.left), np.uint64(self.right))
        halves = [x // sizes[1], x % sizes[1]]
        for i in reversed(range(len(self.keys))) if back else range(len(self.keys)):
            own = i % 2
            shift = self._shift(halves[1 - own], self.keys[i], int(sizes[own]))
            halves[own] = (halves[own] + (sizes[own] - shift if back else shift)) % sizes[own]
        return halves[0] * sizes[1] + halves[1]

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(values).astype(np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("a number is beyond the permutation")
        out = self._once(x, back)
        beyond = np.flatnonzero(out >= self.n)
        while len(beyond):
            out[beyond] = self._once(out[beyond], back)
            beyond = beyond[out[beyond] >= self.n]
        return out.astype(np.int64)

    def forward(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, False)

    def inverse(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, True)


@lru_cache(maxsize=8)
def _feistel(n: int, seed: int) -> Feistel:
    return Feistel(n, seed)


def place_of(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of the row with a number, of ``n`` rows."""
    at = int(_feistel(n, seed).forward(np.array([number]))[0])
    return at % shards, at // shards


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The number of the row at a place. A place that no row has raises."""
    if not 0 <= shard < shards or slot < 0:
        raise ValueError("no such place")
    return int(_feistel(n, seed).inverse(np.array([slot * shards + shard]))[0])


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """Where the permutation of ``n`` rows puts a row's number."""

    @F.pandas_udf("long")
    def move(values: pd.Series) -> pd.Series:
        return pd.Series(_feistel(n, seed).forward(values.to_numpy()))

    return move(number)


def shard_rows(df: DataFrame, order: list[str | Column], shards: int = SHARDS, seed: int = SEED, number: str = "row_number") -> DataFrame:
    """The rows with ``row_number`` (their place from 0 in ``order``, nulls first), ``shard`` and ``slot``.

    ``order`` should tell rows apart that differ: rows that are equal in it may change places from
    run to run. Columns of these names are replaced, others pass through; names that begin with ``__``
    are reserved. An empty table stays empty. All columns are written once, so give what is needed.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = in_order(df.drop(number, "shard", "slot"), order, number, "numbered")
    n = max(rows.count(), 1)
    placed = rows.withColumn("__at", permuted(F.col(number), n, seed))
    return placed.select(*rows.columns, F.expr(f"CAST(__at % {shards} AS INT)").alias("shard"), F.expr(f"__at DIV {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, order: list[str | Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write the rows to one folder for each shard, in order of their slots, and return them as read back.

    Large shards are several files, whose names are in order of the slots. What was at ``path`` is replaced.
    """
    rows = shard_rows(df, order, shards, seed)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``. Only ids, sizes and checksums move.

    Null texts are as empty ones. Documents are numbered by doc_id, of one id by size, checksum and a
    hash of the text; only equal documents change places.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("hash"))
    rows = shard_rows(narrow, ["doc_id", "size", "text_crc32", "hash"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _permuted_sql(rows: str) -> str:
    """SQL for one pass of the permutation over ``rows`` (number, x, n, a, b): (number, y, n, a, b)."""
    mixed = lambda x, shift, factor: f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % {1 << 64}::UHUGEINT AS UBIGINT)"
    at = f"(SELECT number, n, a, b, x // b AS h0, x % b AS h1 FROM {rows})"
    for i, key in enumerate(Feistel(1).keys):
        own, other, size = f"h{i % 2}", f"h{1 - i % 2}", "ab"[i % 2]
        at = f"(SELECT *, CAST(({other}::UHUGEINT + {key}::UHUGEINT) % {1 << 64}::UHUGEINT AS UBIGINT) AS m FROM {at})"
        at = f"(SELECT * REPLACE ({mixed('m', 30, 0xBF58476D1CE4E5B9)} AS m) FROM {at})"
        at = f"(SELECT * REPLACE ({mixed('m', 27, 0x94D049BB133111EB)} AS m) FROM {at})"
        at = f"(SELECT number, n, a, b, ({own} + xor(m, m >> 31) % {size}) % {size} AS {own}, {other} FROM {at})"
    return f"SELECT number, n, a, b, h0 * b + h1 AS y FROM {at}"


def _crc32_sql(data: str) -> str:
    """SQL for the checksum of a blob, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)
        table.append(i)
    half = lambda c: f"xor({c} >> 4, {table}[({c} & 15) + 1])"
    of_bytes = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(coalesce(list_reduce({of_bytes}, lambda c, v: {half(half('xor(c, v)'))}, 4294967295::BIGINT), 4294967295), 4294967295)"


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST({_crc32_sql("encode(coalesce(text, ''))")} AS BIGINT) AS text_crc32 FROM documents),
k AS (SELECT count(*)::UBIGINT AS n, CAST(floor(sqrt(count(*) - 1)) + 1 AS UBIGINT) AS a FROM documents),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS UBIGINT) AS number FROM d),
f AS (SELECT number, number AS x, n, a, (n + a - 1) // a AS b FROM r, k),
w AS (
  {_permuted_sql('f')}
  UNION ALL {_permuted_sql('(SELECT number, y AS x, n, a, b FROM w WHERE y >= n)')}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {SHARDS} AS INTEGER) AS shard, CAST(y // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN w USING (number) WHERE y < n
"""
