"""The fit of the ordinal model against its likelihood: a numeric gradient, other models, a search without gradients; edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import op3_ordinal as O

BITS, RIDGE = 3, 0.08


def data(seed=1, n=80):
    rng = random.Random(seed)
    rows = [sorted(rng.sample(range(1 << BITS), rng.randint(1, 5))) for _ in range(n)]
    grades = [min(2, max(0, round(sum((x % 3) - 1 for x in r) / 2 + 1 + rng.gauss(0, 0.8)))) for r in rows]
    return np.array([x for r in rows for x in r], np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.array(grades), rows


def loss(w, theta, rows, grades):
    """Mean of -log P(grade) and the ridge, by the definition."""
    out = 0.0
    for r, g in zip(rows, grades, strict=True):
        s = sum(w[x] for x in r)
        at_most = [1 / (1 + math.exp(-(t - s))) for t in theta] + [1.0]
        out -= math.log(at_most[g] - (at_most[g - 1] if g else 0.0))
    return out / len(rows) + RIDGE / (2 * math.sqrt(len(rows))) * sum(x * x for x in w)


def test_gradient_is_zero_at_the_fit():
    ids, bounds, grades, rows = data()
    m = O.fit(ids, bounds, grades, bits=BITS, rounds=4000, ridge=RIDGE, rate=0.01)
    assert m.thresholds[0] < m.thresholds[1]
    params = np.concatenate((m.weights, m.thresholds))
    at = lambda p: loss(p[: 1 << BITS], p[1 << BITS :], rows, grades)
    for i in range(len(params)):
        step = np.zeros_like(params)
        step[i] = 1e-4
        assert abs((at(params + step) - at(params - step)) / 2e-4) < 2e-3, i
    rng = np.random.default_rng(2)
    assert all(at(params) <= at(params + rng.normal(0, s, len(params))) + 1e-9 for s in (0.01, 0.1, 0.5) for _ in range(30))


def test_default_rounds_come_near():
    """A search by coordinates, without gradients, finds no much better model."""
    ids, bounds, grades, rows = data(3, 50)
    m = O.fit(ids, bounds, grades, bits=BITS)
    at = lambda p: loss(p[: 1 << BITS], p[1 << BITS :], rows, grades)
    best = np.concatenate((np.zeros(1 << BITS), [-1.0, 1.0]))
    step = 1.0
    while step > 1e-3:
        moved = False
        for i in range(len(best)):
            for d in (step, -step):
                trial = best.copy()
                trial[i] += d
                if trial[-2] < trial[-1] and at(trial) < at(best) - 1e-9:
                    best, moved = trial, True
        step = step if moved else step / 2
    assert at(np.concatenate((m.weights, m.thresholds))) < at(best) + 0.01


@pytest.mark.parametrize("only", [0, 1, 2])
def test_one_grade_only(only):
    ids, bounds, grades, _ = data()
    m = O.fit(ids, bounds, np.full(len(grades), only), bits=BITS)
    tails = m.tails(ids, bounds)
    assert np.isfinite(tails).all() and ((tails.sum(axis=1).round() == only).mean() > 0.95)


def test_clashing_names_ties_and_long_texts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good words here"), (2, "so so"), (3, "bad " * 300_000), (3, "bad")], "doc_id long, text string")
    named = docs.select("*", F.lit(9).alias("grade"), F.lit("x").alias("features"), F.lit(1.0).alias("p_top"), F.lit(True).alias("kept"))
    model = O.fit(*O.sample_features(named, O.graded(labels)), least_rows=1)
    out = O.score(named, model).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3, 3] and all(0 <= r["p_top"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, O.score(docs, model).collect()))
    _, bounds, grades = O.sample_features(named, O.graded(labels))
    assert sorted(grades.tolist()) == [0, 1, 1]  # the least of an id's grades, one text of an id
    first, ids, cut = next(iter(O.features(pa.array(["bad " * 300_000]))))
    assert first == 0 and len(ids) == cut[-1] < 20
