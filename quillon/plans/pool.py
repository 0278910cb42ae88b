"""Keys that rest and recover, tasks that are tried again, progress that is carried on; on events and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.semantics import long
from quillon.operators.library import numbered
from quillon.sources import load

AS_OF = "2024-01-30T23:00:00"


def reports(e):
    """Events as reports on 40 keys: 429, 401 or another error, 'new' where a key is entered again."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", F.when(k % 3 == 0, "429").when(k % 3 == 1, "401").otherwise("other")).otherwise("used")
    return e.select((F.col("user_id") % 40).cast("bigint").alias("id"), "ts", "event_id", kind.alias("kind"))


def key_value(key: Column) -> Column:
    return F.concat(F.when(key % 4 == 0, "nvapi-").otherwise("AIza"), F.lpad(key.cast("string"), 3, "0"))  # of four digits the first three stay


def provider_of(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit("nvapi-")), "nvidia").otherwise("gemini")


def key_states(r, as_of: str):
    """(id, value, provider, status, cooldown_until as ISO text, last_used) of each key at a time: its last report decides, and pauses end."""
    g = r.groupBy("id").agg(F.max_by(F.struct("kind", "ts"), F.when(F.col("kind").isin("429", "401", "new"), F.struct("ts", "event_id"))).alias("last"), F.max("ts").alias("last_used"))
    value = key_value(F.col("id"))
    g = g.select("id", value.alias("value"), provider_of(value).alias("provider"), "last", "last_used")
    until = F.when(F.col("provider") == "nvidia", F.expr("last.ts + INTERVAL 10 SECOND")).otherwise(F.expr("last.ts + INTERVAL 5 MINUTE"))
    rests = (F.col("last.kind") == "429") & (until > F.lit(as_of).cast("timestamp_ntz"))
    status = F.when(F.col("last.kind") == "401", "INVALID").when(rests, "RATE_LIMITED").otherwise("ACTIVE")
    return g.select("id", "value", "provider", status.alias("status"), F.when(rests, F.date_format(until, "yyyy-MM-dd'T'HH:mm:ss")).alias("cooldown_until"), "last_used", (F.col("id") % 5).cast("bigint").alias("weight"))


def q65_key_states(spark, d, as_of: str = AS_OF):
    """The state of each key at a time, with its place in the list, its masked value and its label."""
    s = numbered(key_states(reports(load(spark, d, "events").where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))), as_of), ["id"], "index")
    label = F.when(F.col("status") == "RATE_LIMITED", F.concat(F.lit("Castigo até "), "cooldown_until")).when(F.col("status") == "INVALID", "Revogada (Inválida)").otherwise("Ativa")
    return s.select("id", "index", "provider", F.when(F.length("value") >= 4, F.concat(F.lit("..."), F.right("value", F.lit(4)))).otherwise("***").alias("suffix"), "status", label.alias("label"), "weight")


def q66_best_key(spark, d, as_of: str = AS_OF):
    """The active key to use next: the heaviest, of these the one that has rested longest."""
    s = key_states(reports(load(spark, d, "events").where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))), as_of)
    return s.where("status = 'ACTIVE'").orderBy(F.desc("weight"), "last_used", "id").limit(1).select("id", "provider", "weight")


def q67_cascade(spark, d, models: int = 3):
    """Tasks by their tries: a full quota tries again, another error takes the next model, after the last one the task fails."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0)
    t = load(spark, d, "lineitem").withColumn("errors", F.count_if(F.col("l_returnflag") == "A").over(w)).withColumn("call", F.count(F.lit(1)).over(w))
    ends = (F.col("l_returnflag") == "N") | (F.col("l_returnflag") == "A") & (F.col("errors") == models)
    t = t.withColumn("end", F.when(ends, F.col("call")))
    g = t.groupBy("l_orderkey").agg(F.min("end").alias("end"), F.min_by(F.struct("l_returnflag", "errors"), "end").alias("e"), F.count(F.lit(1)).alias("n"), F.max("errors").alias("errors"))
    status = F.when(F.col("end").isNull(), "pendente").when(F.col("e.l_returnflag") == "N", "concluida").otherwise("erro")
    model = F.when(F.col("end").isNull(), F.col("errors")).otherwise(F.least(F.col("e.errors"), F.lit(models - 1)))
    return g.select(long("l_orderkey").alias("task_id"), status.alias("status"), long(model).alias("model"), long(F.coalesce("end", "n")).alias("calls"))


def q68_polls(spark, d, days: int = 1800):
    """Tasks of exams that ended in time, the percent shown, and what the wait ends with."""
    o = load(spark, d, "orders").select((F.col("o_custkey") % 50).cast("bigint").alias("exam_id"), "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    # two aggregates: a window would sort all tasks of an exam in one task
    first = o.groupBy("exam_id").agg(F.min("day").alias("first"))
    done = (F.col("o_orderstatus") != "P") & (F.date_diff("day", "first") <= days)
    g = o.join(F.broadcast(first), "exam_id").groupBy("exam_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
    return g.select("exam_id", long("total").alias("total"), long("done").alias("done"), long(F.least(F.lit(35) + F.floor(F.col("done") / F.col("total") * 55), F.lit(90))).alias("percent"), F.when(F.col("done") < F.col("total"), "timeout").otherwise("ok").alias("state"))


def q69_ring(spark, d, keep: int = 100):
    """The tasks that ended last, newest first."""
    o = load(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(keep).select(long("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "concluida").otherwise("erro").alias("status"))


def progress(e):
    """Events as progress of exams: a message, a percent, an error now and then, chunks where they are known."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    pct = F.when(F.col("event_type") == "error", -1).when(k >= 90, 100).otherwise(k)
    return e.select(F.col("user_id").cast("bigint").alias("exam_id"), "ts", "event_id", F.col("event_type").alias("status"), pct.cast("bigint").alias("progress"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), k.cast("string"))).alias("error_type"), F.when(k % 4 == 0, k).otherwise(0).alias("total_chunks"), F.when(k % 3 == 0, k).otherwise(0).alias("done_chunks"))


def q70_downloads(spark, d):
    """The latest progress of each exam; errors and chunks are carried on; titles from the exams there are; running ones first."""
    at = F.struct("ts", "event_id")
    some = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, at))
    g = progress(load(spark, d, "events")).groupBy("exam_id").agg(F.max_by(F.struct("status", "progress"), at).alias("l"), F.max_by("error_type", F.when(F.col("error_type").isNotNull(), at)).alias("error_type"), some("total_chunks").alias("total"), some("done_chunks").alias("done"))
    c = load(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    j = g.join(c, F.col("exam_id") == F.col("c_custkey"), "left")
    bucket = F.when(F.col("l.progress").between(0, 99), 0).when(F.col("l.progress") == -1, 1).otherwise(2)
    out = j.select("exam_id", F.coalesce("c_name", F.concat(F.lit("Prova "), F.col("exam_id").cast("string"))).alias("title"), F.col("l.status").alias("status"), F.col("l.progress").alias("progress"), "error_type", long(F.coalesce("total", F.lit(0))).alias("total_chunks"), long(F.coalesce("done", F.lit(0))).alias("done_chunks"), long(bucket).alias("bucket"))
    return out.orderBy("bucket", "exam_id")


def q71_active(spark, d):
    """How many downloads run, failed, ended."""
    b = q70_downloads(spark, d).groupBy("bucket").agg(long(F.count(F.lit(1))).alias("n"))
    return b.select("bucket", "n")


def q72_evicted(spark, d, most: int = 1000, out: int = 200):
    """Progress entries that stay when, over ``most`` of them, the ``out`` oldest go before the next is entered."""
    first = load(spark, d, "orders").groupBy(long("o_custkey").alias("exam_id")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    n = numbered(first.select("exam_id", F.col("f.o_orderdate").alias("at"), F.col("f.o_orderkey").alias("by")), ["at", "by"], "entered")
    size = n.agg(F.count(F.lit(1)).alias("size"))
    gone = F.greatest(F.ceil((F.col("size") - F.lit(most + 1)) / F.lit(out)), F.lit(0)) * out
    return n.join(F.broadcast(size)).where(F.col("entered") > gone).select("exam_id", "entered")


QUERIES = {f.__name__: f for f in (q65_key_states, q66_best_key, q67_cascade, q68_polls, q69_ring, q70_downloads, q71_active, q72_evicted)}
KEYS = f"""
r AS (SELECT CAST(user_id % 40 AS BIGINT) AS id, ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts <= TIMESTAMP '{AS_OF.replace('T', ' ')}'),
c AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'new' WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN '429' WHEN 1 THEN '401' ELSE 'other' END ELSE 'used' END AS kind FROM r),
l AS (SELECT id, arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('429', '401', 'new')) AS kind, max(ts) FILTER (WHERE kind IN ('429', '401', 'new')) AS ts, max(ts) AS last_used FROM c GROUP BY 1),
s AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'nvidia' ELSE 'gemini' END AS provider, ts + CASE WHEN id % 4 = 0 THEN INTERVAL 10 SECOND ELSE INTERVAL 5 MINUTE END AS until FROM l),
t AS (SELECT *, CASE WHEN kind = '401' THEN 'INVALID' WHEN kind = '429' AND until > TIMESTAMP '{AS_OF.replace('T', ' ')}' THEN 'RATE_LIMITED' ELSE 'ACTIVE' END AS status FROM s)"""
_DOWNLOADS = """
e AS (SELECT CAST(user_id AS BIGINT) AS exam_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
p AS (SELECT *, CASE WHEN event_type = 'error' THEN -1 WHEN k >= 90 THEN 100 ELSE k END AS pct FROM e),
g AS (SELECT exam_id, arg_max(event_type, ts) AS status, arg_max(pct, ts) AS progress, arg_max('e' || k, ts) FILTER (WHERE event_type = 'error') AS error_type,
  arg_max(k, ts) FILTER (WHERE k % 4 = 0 AND k > 0) AS total, arg_max(k, ts) FILTER (WHERE k % 3 = 0 AND k > 0) AS done FROM p GROUP BY 1),
b AS (SELECT *, CAST(CASE WHEN progress BETWEEN 0 AND 99 THEN 0 WHEN progress = -1 THEN 1 ELSE 2 END AS BIGINT) AS bucket FROM g)"""
ORACLE_SQL = {
    "q65_key_states": f"""
WITH {KEYS}
SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS index, provider, '...' || right(CASE WHEN id % 4 = 0 THEN 'nvapi-' ELSE 'AIza' END || lpad(CAST(id AS VARCHAR), 3, '0'), 4) AS suffix, status,
  CASE status WHEN 'RATE_LIMITED' THEN 'Castigo até ' || strftime(until, '%Y-%m-%dT%H:%M:%S') WHEN 'INVALID' THEN 'Revogada (Inválida)' ELSE 'Ativa' END AS label, CAST(id % 5 AS BIGINT) AS weight FROM t""",
    "q66_best_key": f"WITH {KEYS} SELECT id, provider, CAST(id % 5 AS BIGINT) AS weight FROM t WHERE status = 'ACTIVE' ORDER BY id % 5 DESC, last_used, id LIMIT 1",
    "q67_cascade": """
WITH w AS (SELECT l_orderkey, l_returnflag AS f, count(*) FILTER (WHERE l_returnflag = 'A') OVER o AS errors, count(*) OVER o AS call FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
g AS (SELECT l_orderkey, min(call) FILTER (WHERE f = 'N' OR f = 'A' AND errors = 3) AS e, arg_min(f, call) FILTER (WHERE f = 'N' OR f = 'A' AND errors = 3) AS f, arg_min(errors, call) FILTER (WHERE f = 'N' OR f = 'A' AND errors = 3) AS x, count(*) AS n, max(errors) AS errors FROM w GROUP BY 1)
SELECT CAST(l_orderkey AS BIGINT) AS task_id, CASE WHEN e IS NULL THEN 'pendente' WHEN f = 'N' THEN 'concluida' ELSE 'erro' END AS status, CAST(CASE WHEN e IS NULL THEN errors ELSE least(x, 2) END AS BIGINT) AS model, CAST(coalesce(e, n) AS BIGINT) AS calls FROM g""",
    "q68_polls": """
WITH o AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS exam_id, o_orderstatus, CAST(o_orderdate AS DATE) AS day, min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey % 50) AS f FROM orders),
g AS (SELECT exam_id, count(*) AS t, count(*) FILTER (WHERE o_orderstatus <> 'P' AND day - f <= 1800) AS d FROM o GROUP BY 1)
SELECT exam_id, CAST(t AS BIGINT) AS total, CAST(d AS BIGINT) AS done, CAST(least(35 + floor(CAST(d AS DOUBLE) / t * 55), 90) AS BIGINT) AS percent, CASE WHEN d < t THEN 'timeout' ELSE 'ok' END AS state FROM g""",
    "q69_ring": "SELECT CAST(o_orderkey AS BIGINT) AS task_id, CASE o_orderstatus WHEN 'F' THEN 'concluida' ELSE 'erro' END AS status FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "q70_downloads": f"""
WITH {_DOWNLOADS}
SELECT exam_id, coalesce(c_name, 'Prova ' || exam_id) AS title, status, CAST(progress AS BIGINT) AS progress, error_type, CAST(coalesce(total, 0) AS BIGINT) AS total_chunks, CAST(coalesce(done, 0) AS BIGINT) AS done_chunks, bucket
FROM b LEFT JOIN customer ON c_custkey = exam_id AND c_custkey % 3 <> 0""",
    "q71_active": f"WITH {_DOWNLOADS} SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1",
    "q72_evicted": """
WITH f AS (SELECT CAST(o_custkey AS BIGINT) AS exam_id, min((o_orderdate, o_orderkey)) AS f FROM orders GROUP BY 1), n AS (SELECT exam_id, CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS entered, count(*) OVER () AS n FROM f)
SELECT exam_id, entered FROM n WHERE entered > 200 * greatest(ceil((n - 1001) / 200.0), 0)""",
}
