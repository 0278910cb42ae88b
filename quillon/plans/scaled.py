"""Queries whose point is how they scale: many keywords, spans by bins, torn JSON, pruned sources, bucketed questions, reloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.mending import parsed, unfenced
from quillon.functions.semantics import long
from quillon.operators.intervals import first_overlap, overlaps
from quillon.operators.library import SOURCE_WORDS
from quillon.operators.matching import best_block
from quillon.operators.patterns import AUTOMATON_BYTES, contained
from quillon.operators.relational import MATCH_STOP_WORDS
from quillon.sources import load
from quillon.sources.loads import ROWS_A_TASK, current, replace, tasks_for
from quillon.sources.sinks import own_path


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of over three letters of all items."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return load(spark, d, "benchmark").select(words.alias("word")).where(F.length("word") > 3).distinct()


def q84_keywords(spark: SparkSession, d: str, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """How many documents contain each of many words, inside other words too."""
    texts = load(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    found = contained(texts, "doc_id", "text", keywords(spark, d), "word", automaton_bytes)
    return found.groupBy(F.col("pattern").alias("word")).agg(long(F.count(F.lit(1))).alias("docs"))


def q85_span_gaps(spark: SparkSession, d: str, margin_s: int = 600) -> DataFrame:
    """Spans of users' events, of up to four days, with the first gap between two errors that they overlap by ten minutes at least, and the bounds of all they overlap."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    spans = e.where("event_type <> 'error'").select("event_id", "user_id", F.col("at").alias("l_start"), (F.col("at") + F.col("k") * 3_600_000_000).alias("l_end"))
    order = W.partitionBy("user_id").orderBy("at", "event_id")
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("gap"), F.lag("at").over(order).alias("r_start"), F.col("at").alias("r_end"))
    pairs = overlaps(spans, errors.where("r_start IS NOT NULL"), ["user_id"], 86_400_000_000, margin_s * 1_000_000)
    first = first_overlap(pairs, ["event_id"], ["r_start", "gap"], ["gap"])
    bounds = pairs.groupBy(F.col("event_id").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.max("r_end").alias("until"))
    out = first.join(bounds, F.col("event_id") == F.col("e"))
    return out.select(long("event_id").alias("event_id"), long("gap").alias("gap"), long("n").alias("gaps"), long("until").alias("until_us"))


def q86_torn_json(spark: SparkSession, d: str) -> DataFrame:
    """Questions in JSON that ends anywhere: those that can be had, and the last whole one. Every third order's answer is whole."""
    li = load(spark, d, "lineitem")
    one = F.concat(F.lit('{"n": '), F.col("l_linenumber").cast("string"), F.lit(', "t": "a\\d ["'), F.lit(', "q": '), F.col("l_partkey").cast("string"), F.lit(', "ok": true}'))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("j")))).alias("r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ", "), F.lit("]"))
    whole = F.concat(F.lit("Sure:\n```json\n"), F.col("text"), F.lit("\n```\nDone."))
    cut = F.when(F.col("l_orderkey") % 3 == 0, whole).otherwise(F.concat(F.lit("```json\n"), F.substring("text", F.lit(1), (F.col("l_orderkey") * 7919 % F.length("text") + 1).cast("int"))))
    # texts in columns of their own are made once
    raw = g.select("l_orderkey", text.alias("text")).select("l_orderkey", cut.alias("cut")).select("l_orderkey", unfenced(F.col("cut")).alias("raw"))
    p = parsed(raw, "raw", "array<struct<n: bigint, t: string, q: bigint, ok: boolean>>", "found")
    full = F.filter("found", lambda x: x["ok"])
    return p.select(long("l_orderkey").alias("order_id"), long(F.coalesce(F.size(full), F.lit(0))).alias("whole"), long(F.aggregate(full, F.lit(0).cast("bigint"), lambda a, x: a + x["q"])).alias("sum_q"))


def landed_hits(spark: SparkSession, d: str, at: str | None = None) -> DataFrame:
    """Pages as hits in a table with a folder for each source."""
    at = at or own_path(spark, "hits")
    source = F.element_at(F.array(*map(F.lit, ("web", "idcap", "pci"))), (F.col("page_id") % 3 + 1).cast("int"))
    load(spark, d, "pages").select("page_id", "url", source.alias("source")).write.mode("overwrite").partitionBy("source").parquet(at)
    return spark.read.schema("page_id bigint, url string, source string").parquet(at)


def wanted_sources(searches: DataFrame) -> DataFrame:
    """(search, source) to plan for, from searches (search, query, board): one that the query names drops the other named ones, else a named board drops other boards' own."""
    every = F.array(F.lit("web"), *(F.lit(s) for s in SOURCE_WORDS))
    query, board = F.lower("query"), F.lower(F.trim(F.coalesce("board", F.lit(""))))
    names = F.filter(every, lambda s: F.exists(F.coalesce(F.try_element_at(F.create_map(*(x for s, w in SOURCE_WORDS.items() for x in (F.lit(s), F.lit(list(w))))), s), F.array().cast("array<string>")), lambda w: F.contains(query, w)))
    named, other = F.get(names, F.lit(0)), F.lit(list(SOURCE_WORDS))
    by_name = F.filter(every, lambda s: (s == named) | ~F.array_contains(other, s))
    by_board = F.filter(every, lambda s: (s != "idcap") | F.contains(board, s))
    return searches.select("search", F.explode(F.when(named.isNotNull(), by_name).when(~board.isin("", "n/a"), by_board).otherwise(every)).alias("source"))


def pruned_hits(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """Hits of the sources that searches want; other sources' files aren't read."""
    return hits.join(F.broadcast(wanted_sources(searches)), "source")


def q87_pruned_sources(spark: SparkSession, d: str) -> DataFrame:
    """Hits for searches that customers make; a segment names a source or a board. Only wanted sources' files are read."""
    hits = landed_hits(spark, d)
    c = load(spark, d, "nation").select(long("n_nationkey").alias("search"), F.when(F.col("n_nationkey") % 2 == 0, "provas ID CAP 2020").otherwise("analista").alias("query"), F.when(F.col("n_nationkey") % 3 == 0, "Vunesp").alias("board"))
    out = pruned_hits(hits, c.where("search % 2 = 0 AND search < 10"))
    return out.select("search", "source", long("page_id").alias("page_id"))


def bucketed(df: DataFrame, key: str, order: list[str], buckets: int, kind: str) -> DataFrame:
    """The rows as a table of buckets by key, sorted inside; joins of such tables by key move no rows."""
    spark, name = df.sparkSession, f"{kind}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order).option("path", own_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def exam_tables(spark: SparkSession, d: str, buckets: int | None = None, most: int = ROWS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """Orders as exams and lines as their questions, inserted in order of exam and number; in as many buckets (8 at least) as the lines fill, as a task holds a bucket."""
    questions = load(spark, d, "lineitem").select(long("l_orderkey").alias("exam_id"), long("l_linenumber").alias("number"), long("l_partkey").alias("part"), long("l_suppkey").alias("supplier"))
    exams = load(spark, d, "orders").select(long("o_orderkey").alias("exam_id"), F.col("o_orderpriority").alias("title"))
    buckets = buckets or max(8, tasks_for(questions.count(), most))
    return bucketed(exams, "exam_id", ["exam_id"], buckets, "exams"), bucketed(questions, "exam_id", ["exam_id", "number", "part", "supplier"], buckets, "questions")


def exam_questions(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with their exams' titles and places in the order they were inserted."""
    place = F.row_number().over(W.partitionBy("exam_id").orderBy("number", "part", "supplier"))
    return exams.hint("merge").join(questions, "exam_id").select("exam_id", "title", "number", "part", place.cast("bigint").alias("place"))


def q88_ordered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Exams with their questions, from tables that are bucketed by exam and sorted, so that nothing is shuffled again."""
    return exam_questions(*exam_tables(spark, d))


def q89_reloaded(spark: SparkSession, d: str, at: str | None = None) -> DataFrame:
    """Questions after two loads: the second was asked for every seventh exam and has rows for half of these."""
    at = at or own_path(spark, "reloaded")
    q = load(spark, d, "lineitem").select(long("l_orderkey").alias("exam_id"), long("l_linenumber").alias("number"), long("l_partkey").alias("part"))
    exams = load(spark, d, "orders").select(long("o_orderkey").alias("exam_id"))
    replace(q, exams, at, "exam_id")
    replace(q.where("exam_id % 14 = 0").withColumn("part", -F.col("part")), exams.where("exam_id % 7 = 0"), at, "exam_id")
    return current(spark, at, "exam_id").select("exam_id", "number", "part")


def q96_best_block(spark: SparkSession, d: str) -> DataFrame:
    """For each answer of a conversation the sentence of its other turns that shares most words with it."""
    c = load(spark, d, "conversations").select(long("conv_id").alias("exam"), long("turn").alias("turn"), "role", "text")
    answers = c.where("role = 'assistant'").select("exam", F.col("turn").alias("item"), "text")
    blocks = c.where("role <> 'assistant'").select("exam", "turn", F.posexplode(F.split("text", r"\. ")).alias("block", "text"))
    return best_block(answers, blocks, ["exam"], ["item"], ["turn", "block"]).select("exam", "item", "turn", long("block").alias("block"), "overlap")


QUERIES = {f.__name__: f for f in (q84_keywords, q85_span_gaps, q86_torn_json, q87_pruned_sources, q88_ordered_questions, q89_reloaded, q96_best_block)}
ORACLE_SQL = {
    "q84_keywords": """
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark), t AS (SELECT lower(text) AS text FROM documents)
SELECT word, count(*) AS docs FROM w JOIN t ON contains(text, word) WHERE length(word) > 3 GROUP BY 1""",
    "q85_span_gaps": """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT user_id, event_id AS gap, lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS s, at_us AS t FROM e WHERE event_type = 'error'),
p AS (SELECT e.event_id, gap, s, t FROM e JOIN g USING (user_id) WHERE event_type <> 'error' AND s IS NOT NULL AND at_us < t - 600000000 AND at_us + k * 3600000000 > s + 600000000)
SELECT event_id, arg_min(gap, (s, gap)) AS gap, count(*) AS gaps, max(t) AS until_us FROM p GROUP BY 1""",
    "q86_torn_json": """
WITH l AS (SELECT l_orderkey AS o, l_partkey AS q, '{"n": ' || l_linenumber || ', "t": "a\\d [", "q": ' || l_partkey || ', "ok": true}' AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
e AS (SELECT *, sum(length(j) + 2) OVER (PARTITION BY o ORDER BY i) - 1 AS upto FROM l),
c AS (SELECT o, CASE WHEN o % 3 = 0 THEN 1000000 ELSE o * 7919 % CAST(max(upto) + 1 AS BIGINT) + 1 END AS cut FROM e GROUP BY 1)
SELECT o AS order_id, count(*) FILTER (WHERE upto - 1 <= cut) AS whole, CAST(coalesce(sum(q) FILTER (WHERE upto - 1 <= cut), 0) AS BIGINT) AS sum_q FROM e JOIN c USING (o) GROUP BY 1""",
    "q87_pruned_sources": """
WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'idcap' ELSE 'pci' END AS source FROM pages), s AS (SELECT CAST(n_nationkey AS BIGINT) AS search FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 10)
SELECT search, source, page_id FROM h, s WHERE source <> 'pci'""",
    "q88_ordered_questions": """
SELECT CAST(l_orderkey AS BIGINT) AS exam_id, o_orderpriority AS title, CAST(l_linenumber AS BIGINT) AS number, CAST(l_partkey AS BIGINT) AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "q89_reloaded": "SELECT CAST(l_orderkey AS BIGINT) AS exam_id, CAST(l_linenumber AS BIGINT) AS number, CAST(CASE WHEN l_orderkey % 14 = 0 THEN -l_partkey ELSE l_partkey END AS BIGINT) AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND (l_orderkey % 7 <> 0 OR l_orderkey % 14 = 0)",
    "q96_best_block": f"""
WITH s AS (SELECT [{", ".join(f"'{w}'" for w in MATCH_STOP_WORDS)}] AS stop),
a AS (SELECT conv_id AS exam, turn AS item, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains(stop, w))) AS aw FROM conversations, s WHERE role = 'assistant'),
x AS (SELECT conv_id AS exam, turn, string_split(text, '. ') AS l FROM conversations WHERE role <> 'assistant'),
y AS (SELECT exam, turn, unnest(range(len(l))) AS block, unnest(l) AS t FROM x),
b AS (SELECT exam, turn, block, list_distinct(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains(stop, w))) AS bw FROM y, s),
p AS (SELECT exam, item, turn, block, len(list_intersect(aw, bw)) AS n, len(bw) AS m FROM a JOIN b USING (exam))
SELECT CAST(exam AS BIGINT) AS exam, CAST(item AS BIGINT) AS item, CAST(arg_min(turn, (-n, turn, block)) AS BIGINT) AS turn, CAST(arg_min(block, (-n, turn, block)) AS BIGINT) AS block, CAST(max(n) AS BIGINT) AS overlap
FROM p WHERE n >= 4 OR n >= 2 AND n > 0.6 * m GROUP BY 1, 2""",
}
