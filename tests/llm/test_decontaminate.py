"""Decontamination: phrases that many items share, items too many to broadcast, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import op9_decontaminate as D

PHRASE = "which one of the following sentences best describes the"


def plain(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = {}
    for item, text in items:
        w = split(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1) if w else ():
            held.setdefault((n, tuple(w[p : p + n])), set()).add(item)
    out = []
    for key, text in docs:
        w, places, met = split(text), set(), set()
        for n in {n for n, _ in held}:
            for p in range(len(w) - n + 1):
                found = held.get((n, tuple(w[p : p + n])))
                if found:
                    places.update(range(p, p + n))
                    met |= found
        out.append((str(key), len(w), sorted(places), sorted(x for x in met if x is not None)))
    return sorted(out)


def shown(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["hit_places"], sorted(r["hit_items"])) for r in df.collect())


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice(("a", "b", "c", "dé", "E", "f1", "g", "h"))
    texts = [" ".join(word() for _ in range(rng.choice((0, 1, 3, 9, 10, 11, 60)))) for _ in range(40)]
    items = [(f"i{k % 25}" if k % 13 else None, rng.choice((" ", "-", "\n")).join(word() for _ in range(rng.choice((0, 1, 4, 7, 9, 10, 12, 30))))) for k in range(40)]
    docs = [(str(k) if k % 11 else None, rng.choice(texts) + ", " + rng.choice(items)[1] + "! " + rng.choice(texts)) for k in range(60)]
    return [*docs, *docs[:5], ("x", None), ("y", ""), ("z", "same id"), ("z", items[3][1])], [*items, *items[:3], ("n", None)]


@pytest.mark.parametrize("limit", [32 << 20, 300, 0])
def test_against_plain(spark, limit):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(3)
    out = D.find_hits(d.withColumn("hit_items", F.lit(1)), spark.createDataFrame(items, "item_id string, text string"), broadcast_bytes=limit)
    assert shown(out) == plain(docs, items)


def test_a_phrase_of_many_items_meets_nothing(spark, monkeypatch):
    rng = random.Random(1)
    some = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    items = spark.createDataFrame([(i, f"{some(20)} {PHRASE} {some(20)}") for i in range(500)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"{some(50)} {PHRASE} {some(50)}"), (2, some(30))], "doc_id int, text string")
    made, keep = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, kind: made.setdefault(kind, keep(df, kind)))
    out = D.find_hits(docs, items)
    assert [(r["hit_places"], r["hit_items"]) for r in out.collect()] == [([], []), ([], [])]
    assert made["met"].count() == 0 and made["touched"].count() <= 1
    assert made["touched"].agg(F.max(F.size("__at"))).first()[0] < 6  # fingerprints of the phrase, whatever the number of items


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert D.find_hits(d.where("false"), i).collect() == []
    assert all(r["hit_places"] == [] for r in D.find_hits(d, i.where("false")).collect())


def test_bitmap_passes_all_and_few_others(spark):
    h = spark.range(2000).select(F.xxhash64("id").alias("h"))
    test = D._maybe_in(h, 2000, 1 << 20)
    assert h.where(test(F.col("h"))).count() == 2000
    assert spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).where(test(F.col("h"))).count() < 4000
