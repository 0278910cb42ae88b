"""Rows that users and services enter: attempts, keys, tasks; as tables after the writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.semantics import long
from quillon.operators.library import numbered
from quillon.plans.library import EXAMS, exams
from quillon.plans.pool import key_value, provider_of
from quillon.sources import load


def q75_submitted(spark, d):
    """Attempts from JSON bodies: missing figures are 0, exams of others are refused, ids go on from the stored ones."""
    o = load(spark, d, "orders").select(long("o_orderkey").alias("n"), (F.col("o_orderkey") * 3 % 20_000).cast("bigint").alias("exam_id"), long("o_custkey").alias("user_id"))
    stored = o.where("n % 2 = 0").select(F.col("n").alias("id"), "exam_id", "user_id", F.lit(1).cast("bigint").alias("score"), F.lit(2).cast("bigint").alias("total"))
    body = F.when(F.col("n") % 3 == 0, F.lit("{}")).when(F.col("n") % 5 == 0, F.lit('{"score": 7, "total": null}')).otherwise(F.format_string('{"score": %d, "total": %d, "answers": {"0": "A"}}', F.col("n") % 11, F.lit(11)))
    sent = o.where("n % 2 = 1").withColumn("b", F.from_json(body, "score bigint, total bigint, answers map<string,string>"))
    own = exams(spark, d).select(F.col("id").alias("e"))
    new = sent.join(own, F.col("exam_id") == F.col("e"), "left_semi").select("n", "exam_id", "user_id", F.coalesce("b.score", F.lit(0)).alias("score"), F.coalesce("b.total", F.lit(0)).alias("total"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = numbered(new, ["n"], "k").join(F.broadcast(top)).select((F.col("top") + F.col("k")).cast("bigint").alias("id"), "exam_id", "user_id", "score", "total")
    return stored.unionByName(placed)


def q76_keys_entered(spark, d):
    """Keys from comma lists: known ones become active again, new ones are added with the provider that their prefix names."""
    s = load(spark, d, "supplier")
    stored = s.where("s_suppkey % 2 = 0").select(key_value(F.col("s_suppkey")).alias("key_value"), F.when(F.col("s_acctbal") < 0, "INVALID").otherwise("ACTIVE").alias("status"), (F.col("s_suppkey") % 7).cast("bigint").alias("weight"))
    lists = s.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("s_suppkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), key_value(F.col("s_suppkey")))))), ",").alias("t"))
    sent = lists.select(F.explode(F.split("t", ",")).alias("k")).select(F.trim("k").alias("k")).where("k <> ''").distinct()
    j = stored.join(sent, F.col("key_value") == F.col("k"), "full_outer")
    key = F.coalesce("key_value", "k")
    return j.select(key.alias("key_value"), provider_of(key).alias("provider"), F.when(F.col("k").isNotNull(), "ACTIVE").otherwise(F.col("status")).alias("status"), F.coalesce("weight", F.lit(10)).cast("bigint").alias("weight"), F.col("key_value").isNull().alias("added"))


def q77_chunk_results(spark, d):
    """Results of chunks as one list in order of the chunks, failed chunks left out; none at all is an error."""
    c = load(spark, d, "conversations").select(long("conv_id").alias("exam_id"), "turn", F.slice(F.split("text", " "), 1, 3).alias("r"), ((F.col("turn") + F.col("conv_id")) % 4 == 0).alias("failed"))
    g = c.groupBy("exam_id").agg(F.sort_array(F.collect_list(F.when(~F.col("failed"), F.struct("turn", "r")))).alias("l"), F.count_if("failed").alias("failed"))
    found = F.flatten(F.transform("l", lambda x: x["r"]))
    return g.select("exam_id", long("failed").alias("failed"), long(F.size(found)).alias("n"), F.array_join(found, "/").alias("results"), F.when((F.size(found) == 0) & (F.col("failed") > 0), "error").otherwise("ok").alias("state"))


def q78_claimed(spark, d, workers: int = 15):
    """Which worker takes which task when tasks are claimed in order of entry: the first ones that wait, a round at a time."""
    o = load(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderdate").alias("at"), long("o_orderkey").alias("task_id"))
    n = numbered(o, ["at", "task_id"], "place")
    return n.select("task_id", ((F.col("place") - 1) % workers).cast("bigint").alias("worker"), F.floor((F.col("place") - 1) / workers).cast("bigint").alias("round"))


QUERIES = {f.__name__: f for f in (q75_submitted, q76_keys_entered, q77_chunk_results, q78_claimed)}
_KEY = "CASE WHEN s_suppkey % 4 = 0 THEN 'nvapi-' ELSE 'AIza' END || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE left(CAST(s_suppkey AS VARCHAR), 3) END"
ORACLE_SQL = {
    "q75_submitted": f"""
WITH {EXAMS}, o AS (SELECT CAST(o_orderkey AS BIGINT) AS n, CAST(o_orderkey * 3 % 20000 AS BIGINT) AS exam_id, CAST(o_custkey AS BIGINT) AS user_id FROM orders),
s AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM o WHERE n % 2 = 1 AND exam_id IN (SELECT id FROM x))
SELECT n AS id, exam_id, user_id, CAST(1 AS BIGINT) AS score, CAST(2 AS BIGINT) AS total FROM o WHERE n % 2 = 0
UNION ALL SELECT CAST(k + (SELECT max(n) FROM o WHERE n % 2 = 0) AS BIGINT), exam_id, user_id, CAST(CASE WHEN n % 3 = 0 THEN 0 WHEN n % 5 = 0 THEN 7 ELSE n % 11 END AS BIGINT), CAST(CASE WHEN n % 3 = 0 OR n % 5 = 0 THEN 0 ELSE 11 END AS BIGINT) FROM s""",
    "q76_keys_entered": f"""
WITH s AS (SELECT *, {_KEY} AS key FROM supplier), t AS (SELECT key, CASE WHEN s_acctbal < 0 THEN 'INVALID' ELSE 'ACTIVE' END AS status, CAST(s_suppkey % 7 AS BIGINT) AS weight FROM s WHERE s_suppkey % 2 = 0),
n AS (SELECT DISTINCT key AS k FROM s WHERE s_suppkey % 5 <> 0)
SELECT coalesce(key, k) AS key_value, CASE WHEN coalesce(key, k) LIKE 'nvapi-%' THEN 'nvidia' ELSE 'gemini' END AS provider, CASE WHEN k IS NOT NULL THEN 'ACTIVE' ELSE status END AS status, CAST(coalesce(weight, 10) AS BIGINT) AS weight, key IS NULL AS added FROM t FULL JOIN n ON key = k""",
    "q77_chunk_results": """
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS exam_id, turn, string_split(text, ' ')[1:3] AS r, (turn + conv_id) % 4 = 0 AS failed FROM conversations)
SELECT exam_id, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failed, CAST(coalesce(sum(len(r)) FILTER (WHERE NOT failed), 0) AS BIGINT) AS n, coalesce(string_agg(array_to_string(r, '/'), '/' ORDER BY turn) FILTER (WHERE NOT failed), '') AS results,
  CASE WHEN count(*) FILTER (WHERE NOT failed) = 0 AND count(*) FILTER (WHERE failed) > 0 THEN 'error' ELSE 'ok' END AS state FROM c GROUP BY 1""",
    "q78_claimed": """
WITH n AS (SELECT CAST(o_orderkey AS BIGINT) AS task_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders WHERE o_orderstatus <> 'F')
SELECT task_id, CAST(p % 15 AS BIGINT) AS worker, CAST(p // 15 AS BIGINT) AS round FROM n""",
}
