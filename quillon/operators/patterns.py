"""Which of many patterns do texts contain?

Up to ``AUTOMATON_BYTES`` of patterns an automaton for all of them is built once in each worker and
reads each text once. Beyond that patterns and texts meet by a shuffle: a pattern stands at its rarest
gram, texts come with the grams that some pattern stands at, and pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of patterns that the driver gathers and workers hold an automaton of (some 80 bytes a byte).
AUTOMATON_BYTES = 2 << 20
#: Characters of a gram; shorter patterns are grams of their own length.
GRAM = 5


@lru_cache(maxsize=2)
def _automaton(patterns: tuple[str, ...]):
    import ahocorasick

    own = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        own.add_word(p, i)
    own.make_automaton()
    return own


def _found(patterns: tuple[str, ...], key: pa.DataType):
    names = pa.array(patterns, pa.string())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(patterns)
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(1)):
                found = sorted({v for _, v in own.iter(text.as_py())})
                hits += found
                rows += [i] * len(found)
            if hits:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(hits))], names=["key", "pattern"])

    return find


def _grams(text, size: int):
    n = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def _by_grams(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    # a row number stands for the text, so that keys may be null or repeated
    texts = texts.withColumn("__row", F.monotonically_increasing_id())
    out = None
    for size in range(1, GRAM + 1):
        own = patterns.where(F.length("pattern") >= GRAM if size == GRAM else F.length("pattern") == size)
        grams = own.select("pattern", F.explode(_grams(F.col("pattern"), size)).alias("gram"))
        in_texts = texts.select("key", "text", F.explode(_grams(F.col("text"), size)).alias("gram"))
        rare = in_texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # a pattern of which one gram is in no text is in none
        at = grams.join(rare, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        pairs = in_texts.join(at, "gram").where(F.contains("text", F.col("pattern"))).select("key", "pattern")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, pattern) for each text and each distinct pattern that stands in it, letter for letter.

    Null texts and null or empty patterns match nothing. Rows of ``texts`` with equal keys stay apart.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = patterns.select(F.col(pattern).alias("pattern")).where(F.length(pattern) > 0).distinct()
    read = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    if (own.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) > automaton_bytes:
        return _by_grams(read, own)
    words = tuple(sorted(r[0] for r in own.collect()))
    kind = texts.schema[key].dataType
    if not words:
        return read.where("false").select("key", F.lit("").alias("pattern"))
    return read.mapInArrow(_found(words, to_arrow_type(kind)), f"key {kind.simpleString()}, pattern string")
