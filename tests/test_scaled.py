"""Keywords, overlaps, torn JSON, pruned sources, buckets and reloads against plain loops, and their plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.mending import mend, parsed, unfenced
from quillon.operators.intervals import first_overlap, overlaps
from quillon.operators.library import active_sources
from quillon.operators.patterns import contained
from quillon.plans import scaled as S
from quillon.sources.loads import current, published, replace

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1 << 21, 10])
def test_patterns_against_contains(spark, limit):
    rng = random.Random(3)
    letters = "abñ中x "
    texts = [None, "", "abab", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    patterns = [None, "", "ab", "ab", "zzzzzz", "中", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(80))]
    t = spark.createDataFrame([(i if i % 7 else None, x) for i, x in enumerate(texts)], "id int, text string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    got = sorted(map(str, map(tuple, contained(t, "id", "text", p, "p", limit).collect())))
    want = [(i if i % 7 else None, x) for i, text in enumerate(texts) if text for x in {x for x in patterns if x} if x in text]
    assert got == sorted(map(str, want))


def test_ten_thousand_words(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    words = [r[0] for r in d.select(F.explode(F.split("text", r"\s+")).alias("w")).where("length(w) > 2").distinct().collect()]
    words = sorted(set(words) | {w[1:] for w in words} | {f"none{i}" for i in range(10_000)})[:]
    assert len(words) >= 10_000
    p = spark.createDataFrame([(w,) for w in words], "w string")
    got = contained(d, "doc_id", "text", p, "w")
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    counts = dict(got.groupBy("pattern").count().collect())
    texts = [r["text"] or "" for r in d.collect()]
    assert counts == {w: n for w in words if (n := sum(w in t for t in texts))}


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    span = lambda: (a := rng.randint(-50, 200), a + rng.choice((0, 1, 5, 60)))
    left = [(k if rng.random() > 0.1 else None, *span(), i) for i in range(120) for k in (rng.choice((1, 1, 1, 2)),)]
    right = [(1 + i % 2, *span(), i) for i in range(60)]
    lf = spark.createDataFrame([*left, (1, None, 5, 999)], "k int, l_start long, l_end long, l int")
    rf = spark.createDataFrame(right, "k int, r_start long, r_end long, r int")
    for margin in (0, 3):
        got = sorted((r["l"], r["r"]) for r in overlaps(lf, rf, ["k"], 10, margin).collect())
        want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] - margin and x[2] > y[1] + margin)
        assert got == want and want
        first = dict(tuple(r) for r in first_overlap(overlaps(lf, rf, ["k"], 10, margin), ["l"], ["r_start", "r"], ["r"]).collect())
        by = {y[3]: y for y in right}
        assert first == {i: min((by[r][1], r) for a, r in want if a == i)[1] for i, _ in want}


def test_a_hot_user_is_split(spark):
    """All intervals are one user's: bins deal them to many tasks."""
    rows = spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("l_start"), (F.col("id") * 100 + 50).alias("l_end"), "id")
    right = rows.select("k", F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"), F.col("id").alias("r"))
    out = overlaps(rows, right, ["k"], 1000)
    assert out.count() == 2000
    assert "__bin" in plan(out)
    spread = rows.withColumn("b", F.floor(F.col("l_start") / 1000)).repartition(8, "k", "b").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 4


ENTRIES = [{"n": 1, "t": 'a "quoted" \\ [x', "o": {"A": "x", "B": None}}, {"n": -2.5, "t": "é\n \U0001f600", "l": [True, False, []]}, {"n": 3}]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_cut_at_every_position(ascii_only):
    text = json.dumps(ENTRIES, ensure_ascii=ascii_only)
    ends = [len(json.dumps(ENTRIES[:k], ensure_ascii=ascii_only)) - 1 for k in range(1, 4)]
    for cut in range(len(text) + 1):
        got = mend(text[:cut])
        if cut == 0:
            assert got is None
            continue
        whole = sum(cut >= e for e in ends)
        value = json.loads(got)
        assert value[:whole] == ENTRIES[:whole] and len(value) <= whole + 1
        for k, v in (value[whole].items() if len(value) > whole else ()):
            want = ENTRIES[whole][k]
            assert v == want or isinstance(v, str) and want.startswith(v) or isinstance(v, (dict, list))


def test_careless_json():
    cases = {
        '{"a": 1,, "b": 2,}': {"a": 1, "b": 2}, "[1 2 3,]": [1, 2, 3], "{'a': 'b\\'": {"a": "b\\"}, '{"a": "x\\d"}': {"a": "x\\d"}, '{"a": tru': {}, '{"a": true': {"a": True}, '{"a"': {}, '{"a": ': {},
        '[{"a": 1}] tail': [{"a": 1}], 'Here: {"a": 1}': {"a": 1}, '{"a": {"b": [1, {"c": 2': {"a": {"b": [1, {}]}}, '{a: 1, "b": 2}': {"b": 2}, "[1, nope, 2]": [1, 2], "]}": None, "  ": None, '"x': "x", '{"a": "\\u00e9\\u12': {"a": "é"},
        "[1, 2": [1], '[{"n": 12': [{}],
    }
    for text, want in cases.items():
        got = mend(text)
        assert (got if got is None else json.loads(got)) == want, text
    assert mend(None) is None


def test_only_refused_rows_are_mended(spark):
    rows = [(1, '```json\n[{"n": 1}]\n```'), (2, '[{"n": 1}, {"n": 2'), (3, None), (4, "nothing"), (5, ' [{"n": "a\\d"}] '), (6, "x ```[{\"n\": 7}]``` y ```[]```"), (7, "")]
    d = spark.createDataFrame(rows, "id int, raw string").withColumn("raw", unfenced(F.col("raw")))
    out = {r["id"]: r["v"] and [x["n"] for x in r["v"]] for r in parsed(d, "raw", "array<struct<n: string>>", "v").collect()}
    assert out == {1: ["1"], 2: ["1", None], 3: None, 4: None, 5: ["a\\d"], 6: ["7"], 7: None}


def test_sources_are_pruned(spark, tmp_path):
    hits = S.landed_hits(spark, SF, str(tmp_path / "hits"))
    given = [(1, "provas ID CAP 2020", None), (2, "pciconcursos", "idcap"), (3, "analista", "Vunesp"), (4, "analista", " IDCAP Brasil"), (5, "analista", "n/a"), (6, "analista", None)]
    s = spark.createDataFrame(given, "search int, query string, board string")
    got = {}
    for r in S.wanted_sources(s).collect():
        got.setdefault(r["search"], []).append(r["source"])
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(active_sources(q, b, ["web", "idcap", "pci"])) for i, q, b in given}
    one = S.pruned_hits(hits, s.where("search = 3"))
    assert "dynamicpruning" in plan(one)
    assert {r["source"] for r in one.select("source").distinct().collect()} == {"web", "pci"}
    # the folder of a source that nobody wants may be gone
    bad = tmp_path / "hits" / "source=idcap"
    for f in bad.glob("*.parquet"):
        f.write_bytes(b"not parquet")
    for f in bad.glob(".*.crc"):
        f.unlink()
    assert S.pruned_hits(hits, s.where("search = 3")).count() == one.count() > 0
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        S.pruned_hits(hits, s.where("search = 6")).select(F.sum("page_id"), F.max("url")).collect()


def test_buckets_need_no_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    exams, questions = S.exam_tables(spark, SF)
    out = S.exam_questions(exams, questions)
    assert "Exchange" not in plan(out)
    places = {}
    for r in out.collect():
        places.setdefault(r["exam_id"], []).append((r["place"], r["number"], r["part"]))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1] for x in v] == sorted(x[1] for x in v) for v in map(sorted, places.values()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reloads(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "exam int, q string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "exam int")
    shown = lambda: sorted(map(tuple, current(spark, at, "exam").collect()))
    with pytest.raises(ValueError):
        current(spark, at, "exam")
    replace(rows((1, "a"), (1, "b"), (2, "c"), (9, "not asked")), keys(1, 2, 2), at, "exam")
    assert shown() == [(1, "a"), (1, "b"), (2, "c")]
    replace(rows((2, "d")), keys(2, 3), at, "exam")
    replace(rows((1, "x")).where("false"), keys(1), at, "exam")  # a reload without rows empties its exam
    assert shown() == [(2, "d")]
    failing = rows((2, "e")).withColumn("q", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        replace(failing, keys(2), at, "exam")
    assert shown() == [(2, "d")] and published(spark, at) == [1, 2, 3]
    replace(rows((1, "back")), keys(1), at, "exam")
    assert shown() == [(1, "back"), (2, "d")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_block_against_all_pairs(spark, seed):
    from quillon.operators.matching import best_block

    rng = random.Random(seed)
    words = ["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg", "que", "x", "São", "the", *(f"w{i:02}" for i in range(20))]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((7, 11, 31))]) for _ in range(n))
    items = [(rng.choice((1, 2, None)), i, text(rng.randint(0, 12))) for i in range(60)]
    blocks = [(rng.choice((1, 2, None)), i // 5, i % 5, rng.choice((None, text(rng.randint(0, 9)), text(3)))) for i in range(80)]
    got = best_block(spark.createDataFrame(items, "k int, i int, text string"), spark.createDataFrame(blocks, "k int, p int, b int, text string"), ["k"], ["i"], ["p", "b"])
    clean = lambda t: {w for w in (t or "").lower().split() if len(w) > 2 and w not in ("que", "são")}
    want = []
    for k, i, t in items:
        best = None
        for k2, p, b, u in sorted(blocks, key=lambda x: x[1:3]):
            n, m = len(clean(t) & clean(u)), len(clean(u))
            if k is not None and k == k2 and (n >= 4 or n >= 2 and n / m > 0.6) and (best is None or n > best[-1]):
                best = (k, i, p, b, n)
        want += [best] if best else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_large_keys_are_cut_into_cells_and_words_stay_together(spark):
    from quillon.operators.matching import best_block

    items = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), F.concat_ws(" ", F.lit("same words here"), F.concat(F.lit("w"), F.col("id") % 10 + 10)).alias("text"))
    blocks = spark.range(60).select((F.col("id") % 2).alias("k"), F.col("id").alias("p"), F.concat_ws(" ", F.lit("here words same"), F.concat(F.lit("w"), F.col("id") % 30 + 10)).alias("text"))
    want = sorted((i % 2, i, i % 10, 4) for i in range(40))
    out = best_block(items, blocks, ["k"], ["i"], ["p"])
    # a row of each word with the whole set, and sets in a broadcast, filled disk and driver
    assert "explode(words" not in plan(out) and "SortMergeJoin" in plan(out)
    for cell in ((500, 5000), (7, 11), (1, 1)):
        out = best_block(items, blocks, ["k"], ["i"], ["p"], cell=cell)
        assert sorted(map(tuple, out.collect())) == want


def joined_rows(spark):
    """The most rows that a join of the last query put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    last = done.apply(done.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_exam_scores_join_no_taker_with_each_question(spark, tmp_path):
    from quillon.plans.stats import q08_exam_scores

    d = str(tmp_path)
    spark.range(400).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'x' AS p_type").write.parquet(f"{d}/part.parquet")
    e = spark.range(1200).selectExpr("id AS event_id", "id % 300 * 25 AS user_id", "timestamp_seconds(id) AS ts", "CASE id % 4 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'view' WHEN 2 THEN NULL ELSE 'error' END AS event_type", "concat('{\"k\": ', id % 450 - 20, '}') AS props")
    e.write.parquet(f"{d}/events.parquet")
    got = {r["user_id"]: (r["total"], r["score"], r["unanswered"], r["percent"]) for r in q08_exam_scores(spark, d).collect()}
    assert 0 < joined_rows(spark) <= 1200
    names, last = ["click", "view", "purchase", "signup", "error"], {}
    for i in range(1200):
        last[i % 300 * 25, i % 450 - 20] = ["click", "view", None, "error"][i % 4]
    for u in range(0, 7500, 25):
        mine = {k: g for (v, k), g in last.items() if v == u and 0 <= k < 400 and g}
        score = sum(g == names[k % 5] for k, g in mine.items())
        assert got[u] == (400, score, 400 - len(mine), int(score / 400 * 100 + 0.5)), u


def test_clock_of_many_hours_as_in_sql(spark, tmp_path):
    import duckdb

    from quillon.plans import ingest

    at = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(k,) for k in (0, 59, 3661, 359_999, 360_000, 899_999, 12_345_678)], "o_orderkey bigint").selectExpr("o_orderkey", "TIMESTAMP'1996-01-02' AS o_orderdate").write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}/*.parquet'")
    want = con.execute(ingest.ORACLE_SQL["q17_date_pack"]).fetchall()
    assert sorted(tuple(r) for r in ingest.q17_date_pack(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in want)


def test_buckets_grow_with_the_lines(spark):
    assert spark.read.parquet(f"{SF}/lineitem.parquet").count() > 5000
    few, many = (S.exam_questions(*S.exam_tables(spark, SF, **k)) for k in ({}, {"most": 200}))
    n = -(-few.count() // 200)
    assert "SelectedBucketsCount: 8 out of 8" in plan(few) and f"SelectedBucketsCount: {n} out of {n}" in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_loads_go_to_more_tasks_as_they_grow(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    at = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("id % 300 AS exam", "id AS q")
    replace(rows, spark.range(0, 290).selectExpr("id AS exam"), at, "exam", 50)
    replace(rows.where("exam % 2 = 0").withColumn("q", -F.col("q")), spark.range(0, 300, 2).selectExpr("id AS exam"), at, "exam", 50)
    assert len(list((tmp_path / "t" / "load=1" / "rows").glob("*.parquet"))) > 8  # not the eight partitions that are set
    out = current(spark, at, "exam", 50)
    assert out.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, out.collect())) == sorted((i % 300, -i if i % 2 == 0 else i) for i in range(1000) if i % 2 == 0 or i % 300 < 290)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_titles_are_cut_once_in_many_tasks(spark):
    from quillon.plans.intake import q57_titles

    n = spark.read.parquet(f"{SF}/part.parquet").count()
    few, many = q57_titles(spark, SF, n), q57_titles(spark, SF, -(-n // 5))
    assert plan(few).count("IDECAN") == 1 and many.rdd.getNumPartitions() == 5  # the cuts stood in the plan wherever their text was used
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_torn_json_is_read_once(spark):
    out = S.q86_torn_json(spark, SF)
    assert "Union" not in plan(out) and plan(out).count("FileScan") == 1
    for text, want in {'[{"a": [[[[1, {"b": 2': [{"a": [[[[1, {}]]]]}], '[{"a": "\\ud83dx"}, {"a": NaN}, [1': [{"a": "x"}, {}, []], "{" * 2000: {}}.items():
        assert json.loads(mend(text)) == want
