"""Answer maps, filters with the store's null rules, nested JSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.semantics import falsy_coalesce, long
from quillon.operators.answers import wrong
from quillon.plans.stats import ATTEMPTS, QUESTIONS, attempts, questions
from quillon.sources import load

_SPACE = " "


def answer_maps(spark: SparkSession, d: str) -> DataFrame:
    """One attempt for each user of ``events``: its answers as JSON text, with keys twice, bad keys, nulls and torn texts."""
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    key = F.when(F.col("event_id") % 13 == 0, "x").when(F.col("event_id") % 17 == 0, "-1").otherwise(F.col("k"))
    value = F.when(F.col("event_id") % 11 == 0, "null").when(F.col("event_id") % 2 == 0, F.concat(F.lit('"' + _SPACE), F.col("event_type"), F.lit(' "'))).otherwise(F.concat(F.lit('"'), F.upper("event_type"), F.lit('"')))
    entry = F.struct("ts", "event_id", F.concat(F.lit('"'), key, F.lit('":'), value).alias("v"))
    texts = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["v"]), ",").alias("t"))
    whole = F.when(F.col("user_id") % 29 == 0, F.concat(F.lit("{"), "t")).when(F.col("user_id") % 31 == 0, "").otherwise(F.concat(F.lit("{"), "t", F.lit("}")))
    return texts.select("user_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("exam_id"), whole.alias("answers_json"))


def q40_answer_maps(spark, d):
    """Wrong answers read from the stored maps: the last of equal keys, bad entries skipped alone, texts trimmed."""
    q = questions(spark, d).select("id", F.col("exam").alias("exam_id"), "subject", F.col("correct").alias("correct_answer"))
    w = wrong(answer_maps(spark, d), q)
    return w.select(long("user_id").alias("user_id"), long("id").alias("question_id"), falsy_coalesce(F.col("subject"), "Geral").alias("subject"), F.lower(F.regexp_replace("given", r"(?U)\s", "")).alias("given"))


def q41_distinct_exams(spark, d):
    """Distinct exams of a user where attempts without an exam count as one more."""
    a = attempts(spark, d).withColumn("exam_id", F.nullif("exam_id", F.lit(7)))
    n = F.countDistinct("exam_id") + F.max(F.col("exam_id").isNull().cast("int"))
    return a.groupBy(long("user_id").alias("user_id")).agg(long(n).alias("exams"), long(F.sum("total")).alias("questions"))


def q42_filters(spark, d, wanted: tuple[str, ...] = ("AUTOMOBILE", "BUILDING"), name: str | None = None):
    """Filters side by side: a list, inequality with and without null, texts that count as missing."""
    c = load(spark, d, "customer").select(long("c_custkey").alias("id"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"), F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_name")).alias("title"))
    if name is not None:
        c = c.where(F.col("title") == name)
    given = F.col("title").isNotNull() & (F.col("title") != "")
    return c.select("id", F.coalesce(F.col("segment").isin(*wanted), F.lit(False)).alias("listed"), F.coalesce(F.col("segment") != "BUILDING", F.lit(False)).alias("differs"), (~F.col("segment").eqNullSafe(F.lit("BUILDING"))).alias("differs_or_null"), given.alias("given"))


def q43_point_lookup(spark, d, exam_id: int = 7):
    """One row by its key, first by id."""
    o = load(spark, d, "orders").where(F.col("o_orderkey") == exam_id).orderBy("o_orderkey").limit(1)
    return o.select(long("o_orderkey").alias("id"), long("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))


def q44_json_report(spark, d):
    """Folders with their exams as JSON, empty ones left out, loose exams in a folder of their own."""
    s = load(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), long("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("folder"), "n_regionkey")
    j = s.join(n, "nation").select(F.when(F.col("n_regionkey") == 0, "avulsas").otherwise(F.col("nation").cast("string")).alias("id"), F.when(F.col("n_regionkey") == 0, "Avulsas").otherwise(F.col("folder")).alias("name"), F.struct(F.col("id").alias("id"), "title").alias("exam"))
    g = j.groupBy("id", "name").agg(F.sort_array(F.collect_list("exam")).alias("exams"), long(F.count(F.lit(1))).alias("n"))
    return g.select("id", "n", F.to_json(F.struct("id", "name", "exams")).alias("report"))


def q45_text_dates(spark, d, as_of: str = "2024-01-30"):
    """Dates from ISO texts (their first ten characters; null where they are none), days to a date, times after a pause."""
    o = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    o = o.withColumn("created", F.when(F.col("o_orderkey") % 10 == 0, "soon").when(F.col("o_orderkey") % 23 == 0, None).otherwise(F.col("iso")))
    day = F.expr("try_to_date(substring(created, 1, 10), 'yyyy-MM-dd')")
    until = F.expr("try_to_timestamp(iso) + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 10 SECOND ELSE INTERVAL 5 MINUTE END")
    return o.select(long("o_orderkey").alias("id"), F.date_format(day, "yyyy-MM-dd").alias("day"), long(F.date_diff(F.lit(as_of).cast("date"), day)).alias("days"), F.date_format(until, "yyyy-MM-dd'T'HH:mm:ss").alias("cooldown_until"))


def q46_exam_subjects(spark, d):
    """Indexes of each exam's questions by subject, in order."""
    g = questions(spark, d).groupBy("exam", falsy_coalesce(F.col("subject"), "Geral").alias("subject")).agg(F.sort_array(F.collect_list("idx")).alias("l"))
    return g.select("exam", "subject", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("indexes"))


def q47_exams_without_attempts(spark, d):
    """Every exam with its best, last and number of attempts; exams that nobody took have none and 0."""
    a = attempts(spark, d).where("status = 'P'").withColumn("p", F.bround(F.try_divide(F.col("score"), F.col("total")) * 100, 1))
    g = a.groupBy("exam_id").agg(F.max("p").alias("best"), F.max_by("p", "attempt_id").alias("last"), F.count(F.lit(1)).alias("n"))
    exams = load(spark, d, "nation").select(F.explode(F.array(long("n_nationkey"), long("n_nationkey") + 40)).alias("id"))
    return exams.join(g, F.col("id") == F.col("exam_id"), "left").select("id", "best", "last", long(F.coalesce("n", F.lit(0))).alias("attempts"))


QUERIES = {f.__name__: f for f in (q40_answer_maps, q41_distinct_exams, q42_filters, q43_point_lookup, q44_json_report, q45_text_dates, q46_exam_subjects, q47_exams_without_attempts)}
ORACLE_SQL = {
    "q40_answer_maps": f"""
WITH {QUESTIONS},
e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 17 = 0 THEN '-1' ELSE json_extract_string(props, '$.k') END AS k,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS given FROM events WHERE user_id % 29 <> 0 AND user_id % 31 <> 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1 AND given IS NOT NULL)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(q.id AS BIGINT) AS question_id, coalesce(nullif(q.subject, ''), 'Geral') AS subject, lower(given) AS given
FROM l JOIN q ON q.exam = 'Brand#' || (user_id % 25 + 1) AND q.idx = TRY_CAST(k AS BIGINT) WHERE TRY_CAST(k AS BIGINT) >= 0 AND lower(given) <> lower(q.correct)""",
    "q41_distinct_exams": f"""
WITH {ATTEMPTS}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(DISTINCT nullif(exam_id, 7)) + max(CASE WHEN exam_id = 7 THEN 1 ELSE 0 END) AS BIGINT) AS exams, CAST(sum(total) AS BIGINT) AS questions
FROM a GROUP BY 1""",
    "q42_filters": """
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS id, nullif(c_mktsegment, 'MACHINERY') AS s, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS t FROM customer)
SELECT id, coalesce(s IN ('AUTOMOBILE', 'BUILDING'), false) AS listed, coalesce(s <> 'BUILDING', false) AS differs, s IS DISTINCT FROM 'BUILDING' AS differs_or_null, t IS NOT NULL AND t <> '' AS given FROM c""",
    "q43_point_lookup": "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS user_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7 ORDER BY o_orderkey LIMIT 1",
    "q44_json_report": """
WITH j AS (SELECT CASE WHEN n_regionkey = 0 THEN 'avulsas' ELSE CAST(n_nationkey AS VARCHAR) END AS id, CASE WHEN n_regionkey = 0 THEN 'Avulsas' ELSE n_name END AS name, s_suppkey, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, CAST(count(*) AS BIGINT) AS n, '{"id":"' || id || '","name":"' || name || '","exams":[' || string_agg('{"id":' || s_suppkey || ',"title":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS report
FROM j GROUP BY id, name""",
    "q45_text_dates": """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(day AS VARCHAR) AS day, CAST(DATE '2024-01-30' - day AS BIGINT) AS days,
  strftime(o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 10 SECOND ELSE INTERVAL 5 MINUTE END, '%Y-%m-%dT%H:%M:%S') AS cooldown_until FROM o""",
    "q46_exam_subjects": f"WITH {QUESTIONS} SELECT exam, coalesce(nullif(subject, ''), 'Geral') AS subject, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indexes FROM q GROUP BY 1, 2",
    "q47_exams_without_attempts": f"""
WITH {ATTEMPTS}, p AS (SELECT exam_id, attempt_id, round_even(CAST(score AS DOUBLE) / total * 100, 1) AS p FROM a WHERE status = 'P'),
g AS (SELECT exam_id, max(p) AS best, arg_max(p, attempt_id) AS last, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT n_nationkey + 40 FROM nation)
SELECT id, best, last, CAST(coalesce(n, 0) AS BIGINT) AS attempts FROM x LEFT JOIN g ON g.exam_id = x.id""",
}
