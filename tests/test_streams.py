"""Streams in one batch, in many, and stopped and started again; against batch results."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.library import numbered
from quillon.streaming import tasks as S
from quillon.streaming.runs import land, landed, run

SF = "/root/testdata/sf0.01"
NAMES = ("q79_polled", "q80_key_changes", "q81_claims", "q82_bounded_map")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("name", NAMES)
def test_one_batch_and_ten(spark, name):
    query = S.QUERIES[name]
    one = rows(query(spark, SF, files=10, files_a_batch=10))
    assert one and one == rows(query(spark, SF, files=10, files_a_batch=1))


def halves(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    mid = e.agg(F.percentile("event_id", 0.5).alias("m")).first()["m"]
    return e, e.where(F.col("event_id") <= mid), e.where(F.col("event_id") > mid)


def test_polls_go_on_after_a_stop(spark, tmp_path):
    e, early, later = halves(spark)
    folder, at = land(early, ["ts"], 4, str(tmp_path / "in")), str(tmp_path / "run")
    first = rows(S.poll(spark, folder, e.schema, at))
    land(later, ["ts"], 4, folder)
    both = rows(S.poll(spark, folder, e.schema, at))
    assert first and set(first) < set(both)
    once = S.poll(spark, land(e, ["ts"], 1), e.schema, str(tmp_path / "once"))
    assert both == rows(once)
    assert {r["state"] for r in once.collect()} == {"concluida", "erro", "timeout"}
    assert rows(S.poll(spark, folder, e.schema, at)) == both  # nothing new


def test_keys_go_on_after_a_stop(spark, tmp_path):
    e, early, later = halves(spark)
    folder, at = land(early, ["ts"], 3, str(tmp_path / "in")), str(tmp_path / "run")
    S.key_changes(S.telling(landed(spark, folder, e.schema)), at)
    land(later, ["ts"], 3, folder)
    both = rows(S.key_changes(S.telling(landed(spark, folder, e.schema)), at).drop("batch"))
    assert both == rows(S.key_changes(S.telling(landed(spark, land(e, ["ts"], 1), e.schema)), str(tmp_path / "once")).drop("batch"))


def test_a_rest_ends_by_its_timer(spark, tmp_path):
    """No report comes after the key's last one, but others' reports move the time on."""
    told = [(1, "gemini", "2024-01-01 00:00:00", 1, "429"), (2, "nvidia", "2024-01-01 00:00:05", 2, "429"), (3, "gemini", "2024-01-01 00:20:00", 3, "401"), (1, "gemini", "2024-01-01 00:02:00", 4, "429"), (3, "gemini", "2024-01-01 01:00:00", 5, "new"), (3, "gemini", "2024-01-01 02:00:00", 6, "401")]
    rows_ = spark.createDataFrame(told, "id long, provider string, ts string, event_id long, kind string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("micros", F.unix_micros("ts"))
    for k, files in enumerate((1, 4)):
        folder = land(rows_, ["ts"], files)
        out = S.key_changes(landed(spark, folder, rows_.schema), str(tmp_path / f"run{k}"), "1 minute").drop("batch")
        got = [(r[0], r[1], r[2], r[3], r[4]) for r in out.withColumn("at", F.date_format("at", "HH:mm:ss")).orderBy("at", "id").collect()]
        assert got == [
            (1, "gemini", "ACTIVE", "RATE_LIMITED", "00:00:00"), (2, "nvidia", "ACTIVE", "RATE_LIMITED", "00:00:05"), (2, "nvidia", "RATE_LIMITED", "ACTIVE", "00:00:15"),
            (1, "gemini", "RATE_LIMITED", "ACTIVE", "00:07:00"), (3, "gemini", "ACTIVE", "INVALID", "00:20:00"), (3, "gemini", "INVALID", "ACTIVE", "01:00:00"),
        ]


@pytest.mark.parametrize("failing", [0, 2, 4])
def test_claims_after_a_crash_between_write_and_commit(spark, tmp_path, failing):
    """The batch has written its rows but isn't committed, so it runs again."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    folder, at = land(e, ["ts"], 6, str(tmp_path / "in")), str(tmp_path / "run")
    stream = S.pushed(landed(spark, folder, e.schema))

    def crash(rows_, batch):
        if batch == failing:
            rows_.withColumn("place", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")
            raise RuntimeError("lost")
        earlier = S.batches(spark, at, before=batch)
        last = 0 if earlier is None else earlier.agg(F.max("place")).first()[0] or 0
        return numbered(rows_, ["pushed", "task_id"], "place").withColumn("place", F.col("place") + F.lit(last).cast("long"))

    with pytest.raises(Exception, match="lost"):
        run(stream, at, each=crash)
    got = [r["place"] for r in S.claims(S.pushed(landed(spark, folder, e.schema)), at).orderBy("pushed", "task_id").collect()]
    assert got == list(range(1, e.where("event_type = 'click'").count() + 1))


def test_map_over_shuffled_rows_and_small_bounds(spark, tmp_path):
    given = [(i % 37, i // 3, i) for i in range(400)]
    d = spark.createDataFrame(given, "exam_id long, at int, by int").orderBy(F.xxhash64("by"))
    names, first = [], set()
    for exam, _, _ in given:
        if exam not in first:
            first.add(exam)
            if len(names) > 10:
                names = names[4:]
            names.append((exam, len(first)))
    for k, files in enumerate((1, 7)):
        stream = landed(spark, land(d, ["at", "by"], files), d.schema)
        assert sorted(map(tuple, S.bounded_map(stream, str(tmp_path / f"run{k}"), most=10, out=4).collect())) == sorted(names)


def test_nothing_landed(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").limit(0)
    folder = land(e, ["ts"], 2)
    assert S.poll(spark, folder, e.schema, str(tmp_path / "a")).collect() == []
    assert S.claims(S.pushed(landed(spark, folder, e.schema)), str(tmp_path / "b")).select("task_id", "place").collect() == []


def test_numbered_ties_and_nulls(spark):
    d = spark.createDataFrame([(None, "b")] * 3 + [(5, None)] * 50 + [(i, "x") for i in range(100)], "k int, t string").repartition(3)
    out = numbered(d, ["k", "t"], "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, 154))
    keys = [((r["k"] is not None, r["k"] or 0), (r["t"] is not None, r["t"] or "")) for r in out]
    assert keys == sorted(keys)
    assert numbered(d.where("false"), ["k"], "n").collect() == []


@pytest.mark.parametrize("name", ["q37_daily_counts", "q38_stream_latest_state", "q73_stream_progress", "q74_stream_keys"])
def test_state_is_carried_from_batch_to_batch(spark, tmp_path, name):
    from quillon.streaming import events

    query, whole = events.QUERIES[name], spark.read.parquet(f"{SF}/events.parquet")
    mid = whole.agg(F.percentile("event_id", 0.4).alias("m")).first()["m"]
    land(whole.where(F.col("event_id") <= mid), ["ts"], 2, f"{tmp_path}/d/events.parquet")
    query(spark, f"{tmp_path}/d", at=f"{tmp_path}/run", files_a_batch=1).count()
    land(whole.where(F.col("event_id") > mid), ["ts"], 2, f"{tmp_path}/d/events.parquet")
    assert rows(query(spark, f"{tmp_path}/d", at=f"{tmp_path}/run", files_a_batch=1)) == rows(query(spark, SF))
    assert len(list((tmp_path / "run" / "state" / "commits").glob("[0-9]*"))) >= 4
