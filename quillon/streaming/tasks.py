"""Tasks and keys while they live: polls with time-outs, keys that recover by timers, a queue claimed in order, a bounded map of progress.

Each query lands ``events`` as files in order of time and runs over them in micro-batches. ``at`` names
the run's folder; called again with the same one, a query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.semantics import long
from quillon.operators.library import numbered
from quillon.plans.pool import key_value, provider_of, reports
from quillon.sources import load
from quillon.sources.sinks import own_path
from quillon.streaming.runs import FILES, batches, land, landed, run

#: How long tasks are waited for, and how late events may come.
MAX_WAIT, LATE = "1800 seconds", "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pushed(events: DataFrame) -> DataFrame:
    """Clicks as tasks that are pushed: (task_id, exam_id, pushed)."""
    return events.where("event_type = 'click'").select(long("event_id").alias("task_id"), long("user_id").alias("exam_id"), F.col("ts").cast("timestamp").alias("pushed"))


def ended(events: DataFrame) -> DataFrame:
    """Purchases and errors as ends of a task shortly before: (ended_task, ended, end_id, status)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(F.col("event_type") == "purchase", "concluida").otherwise("erro")
    own = events.where("event_type IN ('purchase', 'error')")
    return own.select((F.col("event_id") - k % 5 - 1).cast("bigint").alias("ended_task"), F.col("ts").cast("timestamp").alias("ended"), long("event_id").alias("end_id"), status.alias("status"))


def polled(tasks: DataFrame, ends: DataFrame, max_wait: str = MAX_WAIT, late: str = LATE) -> DataFrame:
    """Tasks with their ends as a stream; one that doesn't end in time comes out once the time has passed, with a null ``status``.

    tasks(task_id, pushed, ...), ends(ended_task, ended, status, ...) are streams. State is kept no
    longer than the wait and the lateness.
    """
    left, right = tasks.withWatermark("pushed", late), ends.withWatermark("ended", late)
    in_time = (F.col("task_id") == F.col("ended_task")) & (F.col("ended") >= F.col("pushed")) & (F.col("ended") <= F.col("pushed") + F.expr(f"INTERVAL {max_wait}"))
    return left.join(right, in_time, "left_outer")


def first_ends(rows: DataFrame) -> DataFrame:
    """(task_id, exam_id, pushed, ended, state): the first end of each task counts; a task without one has timed out."""
    first = F.min_by(F.struct("ended", "status"), F.when(F.col("status").isNotNull(), F.struct("ended", "end_id")))
    g = rows.groupBy("task_id").agg(F.any_value("exam_id").alias("exam_id"), F.any_value("pushed").alias("pushed"), first.alias("f"))
    return g.select("task_id", "exam_id", "pushed", F.col("f.ended").alias("ended"), F.coalesce("f.status", F.lit("timeout")).alias("state"))


def poll(spark: SparkSession, folder: str, schema, at: str, files_a_batch: int = 1) -> DataFrame:
    """``first_ends`` of all events that are landed so far."""
    stream = lambda: landed(spark, folder, schema, files_a_batch)
    return first_ends(run(polled(pushed(stream()), ended(stream())), at))


def q79_polled(spark: SparkSession, d: str, at: str | None = None, files: int = FILES, files_a_batch: int = 1) -> DataFrame:
    """How each task ended, as a join of two streams; tasks that may still end in time aren't there yet."""
    events = load(spark, d, "events")
    found = poll(spark, land(events, ["ts", "event_id"], files), events.schema, at or own_path(spark, "polled"), files_a_batch)
    return found.select("task_id", "exam_id", "state", F.floor((F.unix_micros("ended") - F.unix_micros("pushed")) / 1_000_000).cast("bigint").alias("waited_s"))


def running_percent(tasks: DataFrame) -> DataFrame:
    """tasks(exam_id, task_id, ended) with the percent shown when each ended task is seen; ended ones only.

    Sums run over days first, so an exam with very many tasks is counted in days and not in one task.
    """
    day = tasks.where("ended IS NOT NULL").withColumn("day", F.to_date("ended"))
    per_day = day.groupBy("exam_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = per_day.select("exam_id", "day", (F.sum("n").over(W.partitionBy("exam_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    totals = tasks.groupBy("exam_id").agg(F.count(F.lit(1)).alias("total"))
    own = day.withColumn("own", F.row_number().over(W.partitionBy("exam_id", "day").orderBy("ended", "task_id")))
    done = own.join(before, ["exam_id", "day"]).join(totals, "exam_id").withColumn("done", F.col("before") + F.col("own"))
    return done.select("exam_id", "task_id", long("done").alias("done"), long("total").alias("total"), long(F.least(F.lit(35) + F.floor(F.col("done") / F.col("total") * 55), F.lit(90))).alias("percent"))


def q83_running_percent(spark: SparkSession, d: str) -> DataFrame:
    """The percent shown after each end in time of an exam's tasks."""
    events = load(spark, d, "events")
    tasks, ends = pushed(events), ended(events)
    in_time = (F.col("task_id") == F.col("ended_task")) & (F.col("ended") >= F.col("pushed")) & (F.col("ended") <= F.col("pushed") + F.expr(f"INTERVAL {MAX_WAIT}"))
    return running_percent(first_ends(tasks.join(ends, in_time, "left_outer")))


CHANGES = "id long, provider string, from_status string, to_status string, at timestamp"
#: How long a key of a provider rests, in microseconds.
PAUSES = {"nvidia": 10_000_000, "gemini": 300_000_000}


class KeyLife(StatefulProcessor):
    """Changes of a key's status from reports that may come late; rests end by timers of event time.

    Reports wait until the watermark has passed them, so that they count in order of time however they
    are split into batches; one timer stands for what comes next, a report or the end of a rest.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._status = handle.getValueState("status", "status string, until long, provider string")
        self._waiting = handle.getListState("waiting", "at long, event_id long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status = self._status.get() if self._status.exists() else None
        for part in rows:
            status = status or ("ACTIVE", 0, str(part["provider"].iloc[0]))
            self._waiting.appendList([(int(a), int(e), str(k)) for a, e, k in zip(part["micros"], part["event_id"], part["kind"], strict=True)])
        self._status.update(tuple(status))
        yield self._catch_up(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._catch_up(key, timerValues)

    def _catch_up(self, key, timers) -> pd.DataFrame:
        now = timers.getCurrentWatermarkInMs() * 1000
        status, until, provider = self._status.get()
        waiting = sorted(tuple(w) for w in self._waiting.get())
        out = []

        def turn(to: str, at: int) -> None:
            nonlocal status
            if to != status:
                out.append((key[0], provider, status, to, at))
            status = to

        due = [w for w in waiting if w[0] <= now]
        for at, _, kind in due:
            if status == "RATE_LIMITED" and until <= at:
                turn("ACTIVE", until)
            if kind == "429":
                until = at + PAUSES[provider]
            turn({"429": "RATE_LIMITED", "401": "INVALID"}.get(kind, "ACTIVE"), at)
        if status == "RATE_LIMITED" and until <= now:
            turn("ACTIVE", until)
        rest = waiting[len(due) :]
        self._status.update((status, until, provider))
        self._waiting.put(rest) if rest else self._waiting.clear()
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        ahead = [w[0] for w in rest[:1]] + [until] * (status == "RATE_LIMITED")
        if ahead:
            self._handle.registerTimer(-(-min(ahead) // 1000))
        ids, providers, before, after, at = zip(*out, strict=True) if out else ((),) * 5
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "provider": pd.Series(providers, dtype="object"), "from_status": pd.Series(before, dtype="object"), "to_status": pd.Series(after, dtype="object"), "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us")})

    def close(self) -> None:
        pass


def telling(events: DataFrame) -> DataFrame:
    """Reports that change a key: (id, provider, ts, micros, event_id, kind)."""
    told = reports(events).where("kind IN ('429', '401', 'new')").withColumn("ts", F.col("ts").cast("timestamp"))
    return told.select("id", provider_of(key_value(F.col("id"))).alias("provider"), "ts", F.unix_micros("ts").alias("micros"), "event_id", "kind")


def key_changes(stream: DataFrame, at: str, late: str = LATE) -> DataFrame:
    """Changes of status of all keys up to the watermark, from a stream of ``telling`` rows."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need it
    try:
        kept = stream.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(KeyLife(), CHANGES, "append", "eventTime")
        return run(kept, at)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def q80_key_changes(spark: SparkSession, d: str, at: str | None = None, files: int = FILES, files_a_batch: int = 1) -> DataFrame:
    """How keys went from status to status, a rest's end by its timer."""
    events = load(spark, d, "events")
    stream = landed(spark, land(events, ["ts", "event_id"], files), events.schema, files_a_batch)
    return key_changes(telling(stream), at or own_path(spark, "keys")).select("id", "provider", "from_status", "to_status", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed"))


def claims(stream: DataFrame, at: str) -> DataFrame:
    """Tasks (task_id, exam_id, pushed) in the places in which they are claimed, first pushed first, from 1.

    A batch goes on from the last place of those before it, which its folder tells, also when it runs again.
    """
    spark = stream.sparkSession

    def claim(rows: DataFrame, batch: int) -> DataFrame:
        earlier = batches(spark, at, before=batch)
        last = 0 if earlier is None else earlier.agg(F.max("place")).first()[0] or 0
        placed = numbered(rows, ["pushed", "task_id"], "place")
        return placed.withColumn("place", F.col("place") + F.lit(last).cast("bigint"))

    return run(stream, at, each=claim)


def q81_claims(spark: SparkSession, d: str, at: str | None = None, files: int = FILES, files_a_batch: int = 1) -> DataFrame:
    """The queue's tasks in the order in which they are claimed, place by place over many batches."""
    events = load(spark, d, "events")
    stream = landed(spark, land(events, ["ts", "event_id"], files), events.schema, files_a_batch)
    return claims(pushed(stream), at or own_path(spark, "claims")).select("task_id", "exam_id", "place")


def bounded_map(stream: DataFrame, at: str, most: int = 1000, out: int = 200) -> DataFrame:
    """Entries (exam_id, entered) that a map holds when, over ``most`` of them, the ``out`` oldest go before the next is entered.

    ``stream`` has exam_id, at, by, in order of the latter two from batch to batch; only an exam's first
    row enters it. A batch writes the map as it is after it, at most ``most`` + 1 rows: what stays of the
    map before, and the new entries.
    """
    spark = stream.sparkSession

    def enter(rows: DataFrame, batch: int) -> DataFrame:
        earlier = batches(spark, at, before=batch)
        held = None if earlier is None else earlier.where(F.col("batch") == batch - 1).select("exam_id", "first", "entered")
        top = None if held is None else held.agg(F.max_by("first", "entered").alias("first"), F.max("entered").alias("entered")).first()
        # an exam that was entered before began no later than the last one that was
        new = rows if top is None or top["entered"] is None else rows.where(F.col("first") > F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(top["first"], rows.schema["first"].dataType, strict=True))))
        last = 0 if top is None or top["entered"] is None else top["entered"]
        placed = numbered(new.select("exam_id", "first.at", "first.by"), ["at", "by"], "place")
        placed = placed.select("exam_id", F.struct("at", "by").alias("first"), (F.col("place") + F.lit(last)).cast("bigint").alias("entered"))
        size = last + new.count()
        gone = max(-(-(size - most - 1) // out), 0) * out
        every = placed if held is None else held.unionByName(placed)
        return every.where(F.col("entered") > gone)

    firsts = stream.groupBy("exam_id").agg(F.min(F.struct("at", "by")).alias("first"))
    rows = run(firsts, at, "update", each=enter)
    newest = rows.agg(F.max("batch").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("batch") == F.col("newest")).select("exam_id", "entered")


def q82_bounded_map(spark: SparkSession, d: str, at: str | None = None, files: int = FILES, files_a_batch: int = 1) -> DataFrame:
    """Progress entries that a stream of orders leaves in the map."""
    orders = load(spark, d, "orders").select(long("o_custkey").alias("exam_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("by"))
    stream = landed(spark, land(orders, ["at", "by"], files), orders.schema, files_a_batch)
    return bounded_map(stream, at or own_path(spark, "map")).select("exam_id", "entered")


QUERIES = {f.__name__: f for f in (q79_polled, q80_key_changes, q81_claims, q82_bounded_map, q83_running_percent)}
_TASKS = """
t AS (SELECT event_id AS task_id, user_id AS exam_id, ts AS pushed FROM events WHERE event_type = 'click'),
e AS (SELECT event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 - 1 AS ended_task, ts AS ended, event_id AS end_id, event_type FROM events WHERE event_type IN ('purchase', 'error')),
j AS (SELECT task_id, exam_id, pushed, arg_min(event_type, (ended, end_id)) AS kind, min(ended) AS ended FROM t LEFT JOIN e ON task_id = ended_task AND ended >= pushed AND ended <= pushed + INTERVAL 1800 SECOND GROUP BY 1, 2, 3)"""
ORACLE_SQL = {
    "q79_polled": f"""
WITH {_TASKS}, w AS (SELECT least((SELECT max(pushed) FROM t), (SELECT max(ended) FROM e)) - INTERVAL 10 MINUTE AS mark)
SELECT task_id, exam_id, CASE kind WHEN 'purchase' THEN 'concluida' WHEN 'error' THEN 'erro' ELSE 'timeout' END AS state, CAST(floor((epoch_us(ended) - epoch_us(pushed)) / 1000000) AS BIGINT) AS waited_s
FROM j, w WHERE ended IS NOT NULL OR pushed + INTERVAL 1800 SECOND < mark""",
    "q80_key_changes": """
WITH r AS (SELECT user_id % 40 AS id, ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'ACTIVE' WHEN event_type = 'error' AND k % 3 = 0 THEN 'RATE_LIMITED' WHEN event_type = 'error' AND k % 3 = 1 THEN 'INVALID' END AS status, CASE WHEN id % 4 = 0 THEN 'nvidia' ELSE 'gemini' END AS provider FROM r),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM c WHERE status IS NOT NULL),
d AS (SELECT c.*, ts + CASE WHEN provider = 'nvidia' THEN INTERVAL 10 SECOND ELSE INTERVAL 5 MINUTE END AS until, mark FROM c, w WHERE status IS NOT NULL AND ts <= mark),
o AS (SELECT *, lag(status) OVER k AS was, lag(until) OVER k AS rested, lead(ts) OVER k AS next FROM d WINDOW k AS (PARTITION BY id ORDER BY ts, event_id)),
s AS (SELECT id, provider, CASE WHEN was IS NULL OR was = 'RATE_LIMITED' AND rested <= ts THEN 'ACTIVE' ELSE was END AS from_status, status AS to_status, ts AS changed FROM o
  UNION ALL SELECT id, provider, 'RATE_LIMITED', 'ACTIVE', until FROM o WHERE status = 'RATE_LIMITED' AND until <= coalesce(next, mark) AND until <= mark)
SELECT id, provider, from_status, to_status, strftime(changed, '%Y-%m-%d %H:%M:%S.%f') AS changed FROM s WHERE from_status <> to_status""",
    "q81_claims": "SELECT event_id AS task_id, user_id AS exam_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS place FROM events WHERE event_type = 'click'",
    "q82_bounded_map": """
WITH f AS (SELECT CAST(o_custkey AS BIGINT) AS exam_id, min((o_orderdate, o_orderkey)) AS f FROM orders GROUP BY 1), n AS (SELECT exam_id, CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS entered, count(*) OVER () AS n FROM f)
SELECT exam_id, entered FROM n WHERE entered > 200 * greatest(ceil((n - 1001) / 200.0), 0)""",
    "q83_running_percent": f"""
WITH {_TASKS}
SELECT exam_id, task_id, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, CAST(least(35 + floor(CAST(done AS DOUBLE) / total * 55), 90) AS BIGINT) AS percent
FROM (SELECT *, count(ended) OVER (PARTITION BY exam_id ORDER BY ended NULLS LAST, task_id ROWS UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY exam_id) AS total FROM j) WHERE ended IS NOT NULL""",
}
