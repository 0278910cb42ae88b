"""Structured Streaming queries over ``events``, run to completion over what is there.

State and results go to the folder ``at``, by default a new one where driver and executors share files; a
query that is started again with the same one goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.plans.pool import KEYS, key_value, progress, provider_of, reports
from quillon.sources import load, table_path
from quillon.sources.sinks import own_path


def event_stream(spark: SparkSession, d: str, files_a_batch: int | None = None) -> DataFrame:
    """The table as a stream; it may be one file or a folder of files, in any store that Spark reads. Without a limit all files that are there are one batch."""
    path = table_path(d, "events")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    stream = spark.readStream.schema(load(spark, d, "events").schema)
    stream = stream if files_a_batch is None else stream.option("maxFilesPerTrigger", files_a_batch)
    if folder:
        rows = stream.option("pathGlobFilter", "*.parquet").parquet(path)
    else:  # a file stream wants a folder
        at, _, name = path.rpartition("/")
        rows = stream.option("pathGlobFilter", name).parquet(at)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def appended(stream: DataFrame, kind: str, at: str | None = None) -> DataFrame:
    """Rows of an append query, from the table that it wrote."""
    spark, path = stream.sparkSession, at or own_path(stream.sparkSession, kind)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def updated(stream: DataFrame, kind: str, keys: list[str], at: str | None = None) -> DataFrame:
    """The last row of each key of an update query. A batch that runs again replaces what it wrote."""
    spark, path = stream.sparkSession, at or own_path(stream.sparkSession, kind)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    columns = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{path}/rows")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in columns))


def q37_daily_counts(spark: SparkSession, d: str, at: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Daily counts with a 10-minute watermark; the day still open at the end isn't emitted."""
    w = event_stream(spark, d, files_a_batch).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return appended(w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "daily", at)


def q38_stream_latest_state(spark: SparkSession, d: str, at: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The latest state of each user, kept by a streaming aggregation."""
    g = event_stream(spark, d, files_a_batch).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("status"), F.count(F.lit(1)).alias("n"))
    return updated(g.select(F.col("user_id").cast("bigint").alias("user_id"), "status", F.col("n").cast("bigint").alias("n")), "latest", ["user_id"], at)


def q73_stream_progress(spark: SparkSession, d: str, at: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The latest progress of each exam as a stream keeps it: a missing error or chunk count leaves the one before."""
    e = progress(event_stream(spark, d, files_a_batch)).withColumn("at", F.struct("ts", "event_id"))
    some = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, F.col("at")))
    g = e.groupBy("exam_id").agg(F.max_by("status", "at").alias("status"), F.max_by("progress", "at").alias("progress"), F.max_by("error_type", F.when(F.col("error_type").isNotNull(), F.col("at"))).alias("error_type"), F.coalesce(some("total_chunks"), F.lit(0)).cast("bigint").alias("total_chunks"), F.coalesce(some("done_chunks"), F.lit(0)).cast("bigint").alias("done_chunks"))
    return updated(g, "progress", ["exam_id"], at)


def q74_stream_keys(spark: SparkSession, d: str, as_of: str = "2024-01-30T23:00:00", at: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """States of keys kept by a stateful operator: the last report decides, pauses end at a time."""
    e = reports(event_stream(spark, d, files_a_batch).where(F.col("ts") <= F.lit(as_of).cast("timestamp")))
    value = key_value(F.col("id"))
    e = e.select("id", provider_of(value).alias("provider"), F.unix_micros("ts").alias("at"), "event_id", "kind")
    end = int(pd.Timestamp(as_of, tz="UTC").value // 1000)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        provider, kind, at, event = state.get if state.exists else (None, None, -1, -1)
        for rows in parts:
            provider = rows["provider"].iloc[0]
            told = rows[rows["kind"].isin(["429", "401", "new"])]
            if len(told):
                last = told.sort_values(["at", "event_id"]).iloc[-1]
                if (int(last["at"]), int(last["event_id"])) > (at, event):
                    kind, at, event = str(last["kind"]), int(last["at"]), int(last["event_id"])
        state.update((provider, kind, at, event))
        pause = 10_000_000 if provider == "nvidia" else 300_000_000
        status = "INVALID" if kind == "401" else "RATE_LIMITED" if kind == "429" and at + pause > end else "ACTIVE"
        yield pd.DataFrame({"id": [key[0]], "provider": [provider], "status": [status]})

    kept = e.groupBy("id").applyInPandasWithState(follow, "id long, provider string, status string", "provider string, kind string, at long, event long", "update", GroupStateTimeout.NoTimeout)
    return updated(kept, "keys", ["id"], at)


QUERIES = {f.__name__: f for f in (q37_daily_counts, q38_stream_latest_state, q73_stream_progress, q74_stream_keys)}
ORACLE_SQL = {
    "q37_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 10 MINUTE AS DATE) FROM events) GROUP BY 1, 2",
    "q38_stream_latest_state": "SELECT CAST(user_id AS BIGINT) AS user_id, arg_max(event_type, ts) AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "q73_stream_progress": """
WITH p AS (SELECT CAST(user_id AS BIGINT) AS exam_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT exam_id, arg_max(event_type, ts) AS status, CAST(arg_max(CASE WHEN event_type = 'error' THEN -1 WHEN k >= 90 THEN 100 ELSE k END, ts) AS BIGINT) AS progress, arg_max('e' || k, ts) FILTER (WHERE event_type = 'error') AS error_type,
  CAST(coalesce(arg_max(k, ts) FILTER (WHERE k % 4 = 0 AND k > 0), 0) AS BIGINT) AS total_chunks, CAST(coalesce(arg_max(k, ts) FILTER (WHERE k % 3 = 0 AND k > 0), 0) AS BIGINT) AS done_chunks FROM p GROUP BY 1""",
    "q74_stream_keys": f"WITH {KEYS} SELECT id, provider, status FROM t",
}
