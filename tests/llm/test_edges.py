"""Edges of operators that were changed together: languages, equal rows over shards, broadcasts by bytes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import op2_quality, op7_warc, op10_ngram_join
from quillon.llm import shared


def test_one_language_and_told_ones(spark):
    rng = random.Random(2)
    made = lambda lang, k: lang + "".join(chr(97 + k // 14**j % 14) for j in range(3)) + "er" * (k % 2)
    text = lambda lang, n: " ".join(rng.choices([*op2_quality.COMMON[lang], *(made(lang, k) for k in range(200))], [*op2_quality.COMMON[lang].values(), *[(1 - sum(op2_quality.COMMON[lang].values())) / 200] * 200], k=n))
    polish = " ".join(rng.choice("się nie jest że do na przez oraz który tego jako są".split()) + " słowo" + str(k) for k in range(60))
    rows = [(1, text("de", 200), "de"), (2, text("en", 200), "xx"), (3, polish, "pl"), (4, polish, "en"), (5, polish, None), (6, text("fr", 55), ""), (7, None, "pl"), (8, polish, "pl-PL"), (9, text("es", 300), "ES")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r["doc_id"]: r for r in op2_quality.judge(d, lang="lang").collect()}
    plain = {r["doc_id"]: r for r in op2_quality.judge(d).collect()}
    assert {k for k, r in told.items() if r["kept"]} == {1, 2, 3, 6, 8, 9}
    assert {k for k, r in plain.items() if r["kept"]} == {1, 2, 6, 9}
    assert told[3]["word_distance"] is None and told[3]["character_distance"] is None and told[1]["word_distance"] is not None
    assert told[6]["word_distance"] is None and told[6]["character_distance"] is not None


@pytest.mark.parametrize("shard_bytes", [1 << 25, 3000])
def test_equal_rows_over_shard_edges_all_refer(spark, tmp_path, shard_bytes):
    rows = [(3, "http://a", "same " * 30)] * 60 + [(9, "http://b", "same " * 30)] + [(i, "http://c", f"own {i}") for i in range(10, 20)] + [(None, "http://d", "same " * 30)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = op7_warc.write_warc(pages, f"file://{tmp_path}/w", shard_bytes=shard_bytes)
    out = op7_warc.read_warc(spark, f"file://{tmp_path}/w", manifest)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out.collect())
    assert got == Counter({(3, "revisit", 9): 60, (9, "response", None): 1, (None, "revisit", 9): 5, **{(i, "response", None): 1 for i in range(10, 20)}})


def test_broadcasts_are_measured(spark, monkeypatch):
    t = spark.createDataFrame([("x" * 1000,), (None,)], "id string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(shared.small(t, "id")) and not hinted(shared.small(t, "id", limit=1000)) and hinted(shared.small(t.where("false"), "id", limit=0))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_long_ids_and_texts(spark, monkeypatch, limit):
    """Ids of any length are joined by a shuffle where they are too many bytes; a very long text is one row."""
    monkeypatch.setattr(op10_ngram_join, "small", lambda table, *columns: shared.small(table, *columns, limit=limit))
    rng = random.Random(7)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    rows = [("a" * 3000, " ".join(base)), ("b" * 3000, " ".join(near)), ("c", long), ("d", long + " end"), ("e", "alone " * 3), (None, None), ("f", "")]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op10_ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").withColumn("class_id", F.lit(1))).collect()}
    assert out == {"a" * 3000: ("a" * 3000, 1), "b" * 3000: ("a" * 3000, 1), "c": ("c", 1), "d": ("c", 1), "e": ("e", 0), None: (None, 0), "f": ("f", 0)}


def test_a_distance_at_its_limit_is_kept(spark, monkeypatch):
    import math

    rng = random.Random(5)
    words = [*op2_quality.COMMON["en"], *("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150))]
    d = spark.createDataFrame([(1, " ".join(rng.choice(words) for _ in range(160)))], "doc_id long, text string")
    r = op2_quality.judge(d).first()
    assert not r["base_failed"] and r["word_distance"] > 0 and r["character_distance"] > 0
    monkeypatch.setattr(op2_quality, "WORD_DISTANCE_SLACK", 0.0)
    for words_at, chars_at, kept in ((0, 0, True), (-1, 0, False), (0, -1, False), (1, 1, True)):
        near = lambda x, way: x if not way else math.nextafter(x, 2 * way)
        monkeypatch.setattr(op2_quality, "WORD_DISTANCE", near(r["word_distance"], words_at))
        monkeypatch.setattr(op2_quality, "MOST_CHARACTER_DISTANCE", near(r["character_distance"], chars_at))
        assert op2_quality.judge(d).first()["kept"] is kept


def test_chats_with_clashing_names_ties_and_null_ids(spark):
    from quillon.llm import op1_chat

    rows = [(1, None, "user", "b"), (1, None, "assistant", "a"), (1, None, "assistant", "a"), (1, 0, None, None), (None, 1, "assistant", "<|im_end|>\\"), (None, 0, "user\n", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = d.select("*", op1_chat.text_part(F.col("text")).alias("parts"), F.lit("x").alias("turns"), F.lit(2).alias("loss_texts"), F.lit(3).alias("formatted"))
    chats = op1_chat.format_chats(messages)
    read = op1_chat.parse_chats(chats.withColumn("turns", F.lit("old")).withColumn("loss_texts", F.lit("old")))
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], list(r["loss_texts"]), r["n_turns"]) for r in read.collect()}
    assert got == {
        1: ([("assistant", "a"), ("assistant", "a"), ("user", "b"), ("", "")], ["a", "a"], 4),
        None: ([("user\n", "x"), ("assistant", "<|im_end|>\\")], ["<|im_end|>\\"], 2),
    }
    assert op1_chat.parse_chats(op1_chat.format_chats(messages.where("false"))).collect() == []


def test_null_ids_are_refused_by_files_and_kept_by_packing(spark, tmp_path):
    from quillon.llm import op4_packing, op6_token_files

    d = spark.createDataFrame([(None, "no id"), (1, "one")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in op4_packing.pack_documents(d).collect()) == ["1", "None"]
    with pytest.raises(Exception, match="no key"):
        op6_token_files.write_tokens(d, f"file://{tmp_path}/t")
