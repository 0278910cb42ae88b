"""Ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - score) with one score for all grades (shared weights of hashed
features) and ordered thresholds. Grades here: 0 toxic, 1 neither toxic nor of quality, 2 of quality
and not toxic. A document's expected grade is the sum over k of P(grade > k); its tail probability
P(grade >= 2) decides whether it is kept.

The model is fitted on a bounded sample of labelled rows (the ``sample`` rows with the least hash of
their id, 20,000 by default, up to ``sample_bytes`` of features), on the driver in memory bounded by
that; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.llm import kernel as K
from quillon.llm.shared import written

BITS = 18
SAMPLE = 20_000
#: Bytes of the sample's features (4 for each) that come to the driver at most.
SAMPLE_BYTES = 128 << 20
LEAST_TAIL = 0.5
#: Characters whose share of a text is a feature of its own, in steps of a factor of two.
_SHAPES = (b"#*$%&|<>", b"!?", b"{}[]()=;_/\\@~^+", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b".,:")
_SHAPE_OF = np.full(256, len(_SHAPES), np.int64)
for _i, _chars in enumerate(_SHAPES):
    _SHAPE_OF[list(_chars)] = _i


def features(column: pa.Array, bits: int = BITS):
    """For runs of rows: first row, features (distinct within a row), row bounds.

    A text's features are its words, and steps of: the share of each kind of character, the share
    of words that differ, the number of words.
    """
    data, start, end = K.utf8(column)
    mask = K.U64((1 << bits) - 1)
    for i, j in K.blocks(start, end):
        buffer, bounds = K.gather(data, start[i:j], end[i:j])
        n = j - i
        hashes, cut = K.words(buffer, bounds)
        row = np.repeat(np.arange(n), np.diff(cut))
        word = hashes & mask
        kind = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * (len(_SHAPES) + 1) + _SHAPE_OF[buffer], minlength=n * (len(_SHAPES) + 1)).reshape(n, -1)
        size = np.maximum(1, np.diff(bounds))[:, None]
        pair = np.unique(row.astype(np.int64) << bits | word.astype(np.int64))
        distinct = np.bincount(pair >> bits, minlength=n)
        count = np.diff(cut)
        step = np.floor(np.log2(1 + 1024 * kind[:, : len(_SHAPES)] / size)).astype(np.int64)
        extra = np.concatenate((step, (np.ceil(10 * distinct / np.maximum(1, count)))[:, None].astype(np.int64), np.floor(np.log2(1 + count))[:, None].astype(np.int64)), axis=1)
        named = (K.mix64((np.arange(extra.shape[1], dtype=K.U64)[None, :] + K.U64(1)) * K.U64(1 << 32) + extra.astype(K.U64)) & mask).astype(np.int64)
        every = np.unique(np.concatenate((pair, (np.arange(n)[:, None] << bits | named).reshape(-1))))
        yield i, (every & int(mask)).astype(np.int32), np.searchsorted(every >> bits, np.arange(n + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        sums = np.concatenate(([0.0], np.cumsum(self.weights[ids], dtype=np.float64)))
        score = sums[bounds[1:]] - sums[bounds[:-1]]
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(ids: np.ndarray, bounds: np.ndarray, grades: np.ndarray, n_grades: int = 3, bits: int = BITS, rounds: int = 120, ridge: float = 0.08, least_rows: int = 3, rate: float = 0.1) -> Model:
    """Full-batch fit by Adam. Features in fewer than ``least_rows`` rows stay without weight.

    Without rows all probabilities of a tail are one: nothing is known against any document.
    """
    size = 1 << bits
    n = len(grades)
    if not n:
        return Model(np.zeros(size), np.full(n_grades - 1, -50.0))
    used = np.bincount(ids, minlength=size) >= least_rows
    row = np.repeat(np.arange(n), np.diff(bounds))
    keep = used[ids]
    ids, row = ids[keep], row[keep]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    x = np.concatenate((np.zeros(size), first[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(first)
    for t in range(1, rounds + 1):
        w, theta = x[:size], x[size] + np.concatenate(([0.0], np.cumsum(np.exp(x[size + 1 :]))))
        score = np.bincount(row, weights=w[ids], minlength=n)
        edges = np.concatenate((np.full((n, 1), -np.inf), theta[None, :] - score[:, None], np.full((n, 1), np.inf)), axis=1)
        c = _sigmoid(edges)
        d = c * (1 - c)
        i = np.arange(n)
        p = np.maximum(c[i, grades + 1] - c[i, grades], 1e-12)
        up, down = d[i, grades + 1] / p, d[i, grades] / p
        g_score = (up - down) / n  # of the loss -log p
        g = np.zeros_like(x)
        g[:size] = np.bincount(ids, weights=g_score[row], minlength=size) + ridge * w / np.sqrt(n)
        g_theta = np.array([(-(up * (grades == j)) + down * (grades == j + 1)).sum() / n for j in range(k)])
        g[size] = g_theta.sum()
        for j in range(1, k):
            g[size + j] = g_theta[j:].sum() * np.exp(x[size + j])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    x[:size][~used] = 0
    return Model(x[:size].copy(), x[size] + np.concatenate(([0.0], np.cumsum(np.exp(x[size + 1 :])))))


def sample_features(docs: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of the sampled rows, in order of their ids' hashes.

    An id with several grades has the least of them; rows without an id or a grade are left out, and so
    are ids that no document has. Of documents that share an id one counts, that with the least features; null and empty texts
    have the features of an empty text. Texts are read whole. Other columns don't matter. Without rows
    all arrays are empty.
    """
    chosen = graded.where(F.col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min("grade").alias("__grade"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id"))  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, bounds in features(batch.column(3), bits):
                raw = ids.astype("<i4").tobytes()
                packed = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(packed)) for c in range(3)), pa.array(packed, pa.binary())], names=["at", "name", "grade", "features"])

    named = rows.select(F.xxhash64("__id").alias("at"), F.col("__id").cast("string").alias("name"), F.col("__grade").cast("int").alias("grade"), "__text")
    found = named.mapInArrow(run, "at long, name string, grade int, features binary")
    found = written(found.groupBy("at", "name", "grade").agg(F.min("features").alias("features")), "features")
    # a running sum over the sample, at most ``sample`` rows
    so_far = F.sum(F.octet_length("features")).over(W.orderBy("at", "name").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).orderBy("at", "name").select("grade", "features").toArrow()
    parts = [np.frombuffer(x.as_py(), "<i4") for x in found["features"]]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), bounds, np.asarray(found["grade"], np.int64)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """(key, expected_grade, p_top, kept) for each row, repeated ones too.

    Null text scores as empty text; texts are scored whole. Equal texts score alike; a tail probability
    equal to ``least_tail`` is kept. Null keys stay, other columns don't matter, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2 ** bits floats
    bits = int(len(model.weights)).bit_length() - 1
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("expected_grade double, p_top double, kept boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for first, ids, bounds in features(batch.column(1), bits):
                tails = own.tails(ids, bounds)
                top = tails[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(top)), pa.array(tails.sum(axis=1)), pa.array(top), pa.array(top >= least_tail)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of ``labels``; rows without a quality or a toxicity have none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull() | F.col("quality").isNull(), None).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(*sample_features(docs, graded(labels))))
