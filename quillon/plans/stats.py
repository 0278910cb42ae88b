"""History, statistics, rankings, streaks and error notebooks over the standing views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.semantics import falsy_coalesce, half_up, long, pct, pct1, study_time
from quillon.operators.library import numbered
from quillon.operators.relational import ordinal, streak
from quillon.sources import load

ANSWERS = ["click", "view", "purchase", "signup", "error"]


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each order that has lines."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") != "R").alias("score"), (F.sum("l_quantity").cast("bigint") * 60).alias("elapsed_seconds"))
    return load(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("attempt_id"), (F.col("o_orderkey") % 50).alias("exam_id"), "total", "score", "elapsed_seconds", F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))


ATTEMPTS = """a AS (SELECT o_custkey AS user_id, o_orderkey AS attempt_id, o_orderkey % 50 AS exam_id, total, score, elapsed_seconds, o_orderdate AS created, o_orderstatus AS status
 FROM orders JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS score, CAST(sum(l_quantity) AS BIGINT) * 60 AS elapsed_seconds FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("exam"), ordinal(["p_brand"], ["p_partkey"]).alias("idx"), F.nullif("p_type", F.lit("SMALL")).alias("subject"), F.get(F.lit(ANSWERS), (F.col("p_partkey") % 5).cast("int")).alias("correct"))


QUESTIONS = "q AS (SELECT p_partkey AS id, p_brand AS exam, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, nullif(p_type, 'SMALL') AS subject, (['click','view','purchase','signup','error'])[CAST(p_partkey % 5 AS INTEGER) + 1] AS correct FROM part)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("exam"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("idx"), F.col("event_type").alias("given"))


GIVEN = "g AS (SELECT event_id, user_id, ts, 'Brand#' || (user_id % 25 + 1) AS exam, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS idx, event_type AS given FROM events)"


def wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers join questions by position; bounds come with the inner join."""
    joined = answers(spark, d).where("idx >= 0").join(questions(spark, d), ["exam", "idx"])
    return joined.where(F.upper(F.trim("given")) != F.upper(F.trim("correct")))


WRONG = f"{QUESTIONS}, {GIVEN}, w AS (SELECT g.*, q.id, q.subject, q.correct FROM g JOIN q ON g.exam = q.exam AND g.idx = q.idx WHERE g.idx >= 0 AND upper(trim(given)) <> upper(trim(correct)))"
_PCT1 = "CASE WHEN coalesce({q}, 0) > 0 THEN round_even(CAST({c} AS DOUBLE) / {q} * 100, 1) ELSE 0.0 END"


def q01_history(spark, d, user_id: int = 7):
    a = attempts(spark, d).where(F.col("user_id") == user_id)
    return a.select(long("attempt_id").alias("attempt_id"), long("score").alias("score"), long("total").alias("total"), pct1(F.col("score"), F.col("total")).alias("percentage"))


def q02_user_stats(spark, d):
    g = attempts(spark, d).groupBy("user_id").agg(F.countDistinct("exam_id").alias("exams"), F.sum("total").alias("questions"), F.sum("score").alias("correct"), F.sum("elapsed_seconds").alias("seconds"))
    return g.select(long("user_id").alias("user_id"), long("exams").alias("exams"), long("questions").alias("questions"), long("correct").alias("correct"), pct1(F.col("correct"), F.col("questions")).alias("accuracy"), study_time(F.col("seconds")).alias("study_time"))


def q03_ranking(spark, d):
    a = attempts(spark, d).where("status = 'P'").groupBy("user_id").agg(F.sum("total").alias("t"), F.sum("score").alias("s"))
    users = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    j = users.join(a, F.col("id") == F.col("user_id"), "left").select("id", "name", F.coalesce("t", F.lit(0)).alias("questions"), F.coalesce("s", F.lit(0)).alias("correct"))
    placed = numbered(j.select("*", (-F.col("questions")).alias("__q"), (-pct(F.col("correct"), F.col("questions"))).alias("__p")), ["__q", "__p", "id"], "place")
    return placed.select(long("id").alias("user_id"), "name", long("questions").alias("questions"), pct1(F.col("correct"), F.col("questions")).alias("accuracy"), "place")


def q04_streak(spark, d, as_of: str = "2024-01-30"):
    return streak(load(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")), "user_id", "day", as_of)


def q05_wrong_answers(spark, d):
    return wrong_answers(spark, d).select(long("event_id").alias("event_id"), long("user_id").alias("user_id"), long("id").alias("question_id"), "given", "correct")


def q06_errors_by_subject(spark, d):
    return wrong_answers(spark, d).groupBy(falsy_coalesce(F.col("subject"), "Geral").alias("subject")).agg(long(F.count(F.lit(1))).alias("errors")).orderBy(F.desc("errors"), "subject")


def q07_subject_scores(spark, d):
    j = answers(spark, d).where("idx >= 0").join(questions(spark, d), ["exam", "idx"])
    g = j.groupBy(falsy_coalesce(F.col("subject"), "Geral").alias("subject")).agg(F.count_if(F.upper("given") == F.upper("correct")).alias("correct"), F.count(F.lit(1)).alias("total"))
    p = half_up(F.col("correct") / F.col("total") * 100)
    return g.select("subject", long("correct").alias("correct"), long("total").alias("total"), p.alias("percent"), F.when(p >= 70, "good").when(p >= 40, "mid").otherwise("bad").alias("bucket"))


def q08_exam_scores(spark, d):
    """Every question of the exam counts; missing answers are wrong; the latest answer of a position holds."""
    a = answers(spark, d).groupBy("user_id", "exam", "idx").agg(F.max_by("given", F.struct("ts", "event_id")).alias("given"))
    q = questions(spark, d).select("exam", "idx", "correct", F.lit(True).alias("asked"))
    # answers are counted alone and questions once an exam: takers times questions would grow with the square of the tables
    given = a.join(q, ["exam", "idx"], "left").groupBy("user_id", "exam").agg(F.count_if(F.upper("given") == F.upper("correct")).alias("score"), F.count_if(F.col("asked") & F.col("given").isNotNull()).alias("answered"))
    g = given.join(q.groupBy("exam").agg(F.count(F.lit(1)).alias("total")), "exam").withColumn("unanswered", F.col("total") - F.col("answered"))
    return g.select(long("user_id").alias("user_id"), "exam", long("total").alias("total"), long("score").alias("score"), long("unanswered").alias("unanswered"), half_up(F.col("score") / F.col("total") * 100).alias("percent"))


def q09_error_notebook(spark, d, subject: str | None = None, limit: int = 100):
    counts = wrong_answers(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("error_count"))
    rows = questions(spark, d).join(counts, "id")
    if subject is not None:
        rows = rows.where(falsy_coalesce(F.col("subject"), "Geral") == subject)
    return rows.orderBy("id").limit(limit).select(long("id").alias("question_id"), "exam", falsy_coalesce(F.col("subject"), "Geral").alias("subject"), long("error_count").alias("error_count"))


def q12_best_last_count(spark, d):
    a = attempts(spark, d).withColumn("p", pct(F.col("score"), F.col("total")))
    g = a.groupBy("user_id").agg(F.max("p").alias("best"), F.max_by("p", "attempt_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select(long("user_id").alias("user_id"), F.bround("best", 1).alias("best"), F.bround("last", 1).alias("last"), long("n").alias("attempts"))


def q13_nested_report(spark, d):
    """Regions with their nations' figures as one text; nations without rich suppliers in a group of their own."""
    rich = load(spark, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("s_acctbal").alias("best"))
    n = load(spark, d, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    inside = n.where("n IS NOT NULL").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), "n_nationkey", "n_name", "n")
    loose = n.where("n IS NULL").select(F.lit("avulsas").alias("id"), F.lit("Avulsas").alias("title"), "n_nationkey", "n_name", F.lit(0).cast("bigint").alias("n"))
    entry = F.struct(F.col("n_nationkey").alias("k"), F.concat_ws(":", "n_name", F.col("n").cast("string")).alias("v"))
    return inside.unionByName(loose).groupBy("id", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"]), ",").alias("nations"))


def q14_group_to_list(spark, d):
    g = questions(spark, d).where("exam = 'Brand#1'").groupBy(falsy_coalesce(F.col("subject"), "Geral").alias("subject")).agg(F.sort_array(F.collect_list("idx")).alias("l"))
    return g.select("subject", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("indexes"))


QUERIES = {f.__name__: f for f in (q01_history, q02_user_stats, q03_ranking, q04_streak, q05_wrong_answers, q06_errors_by_subject, q07_subject_scores, q08_exam_scores, q09_error_notebook, q12_best_last_count, q13_nested_report, q14_group_to_list)}
B = "CAST({0} AS BIGINT) AS {1}".format
ORACLE_SQL = {
    "q01_history": f"WITH {ATTEMPTS} SELECT {B('attempt_id', 'attempt_id')}, {B('score', 'score')}, {B('total', 'total')}, {_PCT1.format(c='score', q='total')} AS percentage FROM a WHERE user_id = 7",
    "q02_user_stats": f"WITH {ATTEMPTS}, g AS (SELECT user_id, count(DISTINCT exam_id) AS exams, sum(total) AS t, sum(score) AS s, CAST(sum(elapsed_seconds) AS BIGINT) AS sec FROM a GROUP BY 1) SELECT {B('user_id', 'user_id')}, {B('exams', 'exams')}, {B('t', 'questions')}, {B('s', 'correct')}, {_PCT1.format(c='s', q='t')} AS accuracy, CASE WHEN sec >= 3600 THEN (sec // 3600) || 'h ' || (sec % 3600 // 60) || 'm' ELSE (sec % 3600 // 60) || 'm' END AS study_time FROM g",
    "q03_ranking": f"WITH {ATTEMPTS}, g AS (SELECT c_custkey AS id, c_name AS name, coalesce(sum(total), 0) AS t, coalesce(sum(score), 0) AS s FROM customer LEFT JOIN (SELECT * FROM a WHERE status = 'P') ON c_custkey = user_id GROUP BY 1, 2) SELECT {B('id', 'user_id')}, name, {B('t', 'questions')}, {_PCT1.format(c='s', q='t')} AS accuracy, {B('row_number() OVER (ORDER BY t DESC, CASE WHEN t > 0 THEN CAST(s AS DOUBLE) / CAST(t AS DOUBLE) * 100 ELSE 0 END DESC, id)', 'place')} FROM g",
    "q04_streak": f"WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), y AS (SELECT *, day + CAST(row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS INTEGER) AS island FROM x), r AS (SELECT user_id, island, max(day) AS l, count(*) AS n FROM y GROUP BY 1, 2), z AS (SELECT *, max(l) OVER (PARTITION BY user_id) AS m FROM r) SELECT user_id, {B('n', 'streak')} FROM z WHERE l = m AND DATE '2024-01-30' - l IN (0, 1)",
    "q05_wrong_answers": f"WITH {WRONG} SELECT {B('event_id', 'event_id')}, {B('user_id', 'user_id')}, {B('id', 'question_id')}, given, correct FROM w",
    "q06_errors_by_subject": f"WITH {WRONG} SELECT coalesce(nullif(subject, ''), 'Geral') AS subject, {B('count(*)', 'errors')} FROM w GROUP BY 1",
    "q07_subject_scores": f"WITH {QUESTIONS}, {GIVEN}, j AS (SELECT coalesce(nullif(subject, ''), 'Geral') AS subject, count(*) FILTER (WHERE upper(given) = upper(correct)) AS c, count(*) AS t FROM g JOIN q ON g.exam = q.exam AND g.idx = q.idx WHERE g.idx >= 0 GROUP BY 1), p AS (SELECT *, CAST(floor(CAST(c AS DOUBLE) / t * 100 + 0.5) AS BIGINT) AS percent FROM j) SELECT subject, {B('c', 'correct')}, {B('t', 'total')}, percent, CASE WHEN percent >= 70 THEN 'good' WHEN percent >= 40 THEN 'mid' ELSE 'bad' END AS bucket FROM p",
    "q08_exam_scores": f"WITH {QUESTIONS}, {GIVEN}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, exam, idx ORDER BY ts DESC, event_id DESC) AS rn FROM g) WHERE rn = 1), t AS (SELECT DISTINCT user_id, exam FROM l), f AS (SELECT t.user_id, t.exam, q.correct, l.given FROM t JOIN q ON q.exam = t.exam LEFT JOIN l ON l.user_id = t.user_id AND l.exam = t.exam AND l.idx = q.idx) SELECT {B('user_id', 'user_id')}, exam, {B('count(*)', 'total')}, {B('count(*) FILTER (WHERE upper(given) = upper(correct))', 'score')}, {B('count(*) FILTER (WHERE given IS NULL)', 'unanswered')}, CAST(floor(CAST(count(*) FILTER (WHERE upper(given) = upper(correct)) AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS percent FROM f GROUP BY user_id, exam",
    "q09_error_notebook": f"WITH {WRONG}, c AS (SELECT id, count(*) AS n FROM w GROUP BY 1) SELECT {B('q.id', 'question_id')}, exam, coalesce(nullif(subject, ''), 'Geral') AS subject, {B('n', 'error_count')} FROM q JOIN c ON q.id = c.id ORDER BY q.id LIMIT 100",
    "q12_best_last_count": f"WITH {ATTEMPTS}, p AS (SELECT *, CAST(score AS DOUBLE) / total * 100 AS p FROM a) SELECT {B('user_id', 'user_id')}, round_even(max(p), 1) AS best, round_even(arg_max(p, attempt_id), 1) AS last, {B('count(*)', 'attempts')} FROM p GROUP BY user_id",
    "q13_nested_report": "WITH r AS (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), x AS (SELECT CASE WHEN n IS NULL THEN 'avulsas' ELSE CAST(r_regionkey AS VARCHAR) END AS id, CASE WHEN n IS NULL THEN 'Avulsas' ELSE r_name END AS title, n_nationkey, n_name || ':' || coalesce(n, 0) AS v FROM nation LEFT JOIN r ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT id, title, string_agg(v, ',' ORDER BY n_nationkey) AS nations FROM x GROUP BY 1, 2",
    "q14_group_to_list": f"WITH {QUESTIONS} SELECT coalesce(nullif(subject, ''), 'Geral') AS subject, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indexes FROM q WHERE exam = 'Brand#1' GROUP BY 1",
}
