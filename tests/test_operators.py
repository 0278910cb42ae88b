from datetime import date

from pyspark.sql import functions as F

from quillon.functions.semantics import falsy_coalesce, pct1, study_time, unicode_trim
from quillon.operators.relational import best_overlap, delete_cascade, get_or_create, streak, sync_actions, upsert


def test_expressions(spark):
    row = spark.range(1).select(
        pct1(F.lit(1), F.lit(16)).alias("a"), pct1(F.lit(1), F.lit(0)).alias("b"), pct1(F.lit(None), F.lit(None)).alias("c"), falsy_coalesce(F.lit(""), "Geral").alias("d"), study_time(F.lit(3900)).alias("e"), study_time(F.lit(60)).alias("f"), unicode_trim(F.lit(" x ")).alias("g")
    ).first()
    assert tuple(row) == (6.2, 0.0, 0.0, "Geral", "1h 5m", "1m", "x")


def test_streak_edges(spark):
    days = [("today", date(2024, 1, 30)), ("today", date(2024, 1, 29)), ("today", date(2024, 1, 29)), ("yesterday", date(2024, 1, 29)), ("old", date(2024, 1, 28)), ("future", date(2024, 1, 31)), ("gap", date(2024, 1, 30)), ("gap", date(2024, 1, 28)), ("none", None)]
    got = {r[0]: r[1] for r in streak(spark.createDataFrame(days, "k string, d date"), "k", "d", "2024-01-30").collect()}
    assert got == {"today": 2, "yesterday": 1, "gap": 1}


def test_dml_patterns(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id int, url string, score int")
    new = spark.createDataFrame([("b", 9), ("c", 8)], "url string, score int")
    assert sorted(map(str, (tuple(r) for r in sync_actions(stored, new, "url").collect()))) == sorted(map(str, [("a", "delete"), ("b", "update"), ("c", "insert"), (None, "delete")]))
    assert {(r.url, r.score) for r in upsert(stored.where("url IS NOT NULL"), new, "url", ["score"]).collect()} == {("a", 5), ("b", 9), ("c", 8)}
    assert {(r.id, r.url) for r in get_or_create(stored.where("url IS NOT NULL"), new, "url", "id").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    a, b = delete_cascade(stored, spark.createDataFrame([(1,), (2,), (None,)], "parent int"), stored.where("id = 1").select("id"), "id", "parent")
    assert a.count() == 2 and {r[0] for r in b.collect()} == {2, None}


def test_best_overlap(spark):
    items = [(1, "The cat saw two red owls"), (2, "lion bear"), (3, "sol mar para com que"), (4, None), (5, "ação é não José 1999 fim"), (6, "uma a o"), (None, "cat saw")]
    docs = [(9, "cat saw red owls and more words that nobody asked for here"), (2, "cat saw red"), (7, "CAT, saw: red owls!"), (3, "lion bear wolf"), (1, "lion bear wolf fox"), (4, "sol mar para com que"), (5, "ação José 1999 fim x"), (6, None), (None, "the cat saw two red owls")]
    got = best_overlap(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), "item_id", "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, 7, 4), (2, 3, 2), (3, 4, 2), (4, None, 0), (5, 5, 4), (6, None, 0)]


def test_block_match_against_the_rule(spark):
    """The reference's loop over all pairs, on the smallest tables."""
    import re

    from quillon.plans import catalogue

    d = "/root/testdata/sf0.001"
    stop = {"o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "para", "por", "com", "sem", "que", "e", "ou", "mas", "se", "como", "é", "são", "foi", "nao", "não"}
    read = lambda name, key: [(r[0], {w for w in set(re.findall(r"\w+", r[1].lower())) if len(w) > 2 and w not in stop}) for r in spark.read.parquet(f"{d}/{name}.parquet").select(key, "text").orderBy(key).collect()]
    docs, want = read("documents", "doc_id"), []
    for item, q in read("benchmark", "item_id"):
        best, most = None, 0
        for doc, b in docs:
            n = len(q & b)
            if b and n > most and (n >= 4 or n >= 2 and n / len(b) > 0.6):
                best, most = doc, n
        want.append((item, best, most))
    assert sorted(map(tuple, catalogue.QUERIES["q39_block_match"](spark, d).collect())) == want
