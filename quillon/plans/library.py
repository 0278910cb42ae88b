"""Search, triage and loading of exams, on pages, orders and lines that stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.semantics import falsy_coalesce, long
from quillon.operators.library import active_sources, copies, delete_exams, folder_name, numbered, relevance, skipped, source_label, source_of, target_words, union_hits
from quillon.sources import load
from quillon.sources.sinks import append, own_path, reload_partitions


def q48_search(spark, d, query: str = "prova de analista", board: str = "", sources: tuple[str, ...] = ("web", "idcap", "pci")):
    """Hits of the sources that the query leaves active, each up to its cap, the first of equal URLs, best scores first."""
    p = load(spark, d, "pages").select("page_id", F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("url"))
    p = p.withColumn("url", F.regexp_replace("url", r"/[0-9]+(\.html)?/?$", "/doc.pdf")).withColumn("pos", F.col("page_id"))
    title = F.substring_index("url", "//", -1)
    score = F.when(F.col("page_id") % 4 == 0, None).otherwise(F.col("page_id") % 97)
    hits = {
        "web": p.where("page_id % 3 <> 1 AND contains(lower(url), '.pdf')").select("url", F.concat(F.lit("Web - "), F.left(title, F.lit(60))).alias("title"), F.lit(None).cast("bigint").alias("score"), "pos"),
        "idcap": p.where("page_id % 3 <> 2").select("url", F.concat(F.lit("IDCAP - "), title).alias("title"), score.alias("score"), "pos"),
        "pci": p.where("page_id % 5 < 3").select("url", F.concat(F.lit("PCI - "), title).alias("title"), (F.col("page_id") % 89).alias("score"), "pos"),
    }
    u = union_hits(hits, active_sources(query, board, list(sources)), {"web": 8, "idcap": 25, "pci": 15})
    shown = source_of(F.col("title"), F.col("url"))
    return u.select("url", "title", long(F.coalesce("score", F.lit(0))).alias("score"), shown.alias("source"), source_label(shown).alias("label")).orderBy(F.desc("score"), "url")


SEARCHES = [(1, "prova the analista", "n/a", "that and"), (2, "de da do", None, None), (3, "concurso for of and", "the", "n/a"), (4, "xyzzy", "", "qwerty"), (5, "", "n/a", "and the")]


def q49_relevance(spark, d):
    """The full score of each title under a few searches (query, board, role)."""
    s = spark.createDataFrame(SEARCHES, "search long, query string, board string, role string")  # a handful
    s = s.withColumn("words", target_words(F.col("query"), F.col("board"), F.col("role")))
    # a handful of searches goes into the rows, so nothing is joined
    words = lambda r: F.array(*map(F.lit, r["words"])).cast("array<string>")
    asked = F.array(*(F.struct(F.lit(r["search"]).alias("search"), words(r).alias("words"), F.lit(r["role"]).cast("string").alias("role")) for r in s.collect()))
    t = load(spark, d, "benchmark").select(long("item_id").alias("item_id"), F.left("text", F.lit(100)).alias("title"), F.explode(asked).alias("s"))
    return t.select("s.search", "item_id", relevance(F.col("title"), F.col("s.words"), F.col("s.role")).alias("score"))


def q50_listing(spark, d, cap: int = 25):
    """Links in the lists of pages whose texts have none of the stems of what is no exam; the first ones by page and place."""
    lists = F.regexp_extract_all("html", F.lit(r"(?s)<ul>.*?</ul>"), F.lit(0))
    a = load(spark, d, "pages").select("page_id", F.posexplode(lists).alias("list", "body"))
    a = a.select("page_id", "list", F.posexplode(F.regexp_extract_all("body", F.lit('(<a href="[^"]*">[^<]*)</a>'), F.lit(1))).alias("pos", "a"))
    a = a.select("page_id", "list", "pos", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("link"), F.lower(F.regexp_extract("a", ">([^<]*)$", 1)).alias("name"))
    return a.where(~skipped(F.col("name"))).orderBy("page_id", "list", "pos").limit(cap).select(long("page_id").alias("page_id"), long("list").alias("list"), long("pos").alias("pos"), "link", "name")


def exams(spark, d):
    """Orders as exams: their source one of many others', their folder the customer's."""
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "Aprovada").when(F.col("o_orderstatus") == "F", "Pendente").otherwise("Negada")
    source = F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.concat(F.lit("http://s/"), (F.col("o_custkey") % 700).cast("string"), F.lit("?v="), (F.col("o_orderkey") % 3).cast("string")))
    return o.select(long("o_orderkey").alias("id"), F.concat(F.lit("Prova - "), F.col("o_orderpriority"), F.lit(".pdf")).alias("title"), status.alias("status"), F.when(F.col("o_orderkey") % 5 != 0, long("o_custkey")).alias("folder_id"), long("o_custkey").alias("user_id"), source.alias("source_url"), (F.col("o_orderkey") % 101).cast("bigint").alias("match_score"))


EXAMS = """x AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'Prova - ' || o_orderpriority || '.pdf' AS title, CASE o_orderstatus WHEN 'P' THEN 'Aprovada' WHEN 'F' THEN 'Pendente' ELSE 'Negada' END AS status,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS folder_id, CAST(o_custkey AS BIGINT) AS user_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'http://s/' || (o_custkey % 700) || '?v=' || (o_orderkey % 3) END AS source_url, CAST(o_orderkey % 101 AS BIGINT) AS match_score FROM orders)"""


def q51_copies(spark, d):
    """How many questions each pending exam copies from the approved exam of its source, and a sum to know them by."""
    q = load(spark, d, "lineitem").select(long("l_partkey").alias("id"), long("l_orderkey").alias("exam_id"), "l_linenumber")
    return copies(exams(spark, d), q).groupBy("exam_id").agg(long(F.count(F.lit(1))).alias("copied"), long(F.sum("copied_from")).alias("questions"))


def q52_deleted(spark, d):
    """What stays in each folder when denied exams go, with all that hangs on them; folders go with their last exam."""
    x, c = exams(spark, d), load(spark, d, "customer").select(long("c_custkey").alias("id"), "c_name")
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("exam_id"))
    folders, left, children = delete_exams(c, x, lines, x.where("status = 'Negada'"))
    per_exam = children.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n"))
    g = left.where("folder_id IS NOT NULL").join(per_exam, F.col("id") == F.col("exam_id"), "left").groupBy("folder_id").agg(F.count(F.lit(1)).alias("exams"), F.coalesce(F.sum("n"), F.lit(0)).alias("questions"))
    return folders.join(g, F.col("id") == F.col("folder_id"), "left").select(F.col("id").alias("folder_id"), long(F.coalesce("exams", F.lit(0))).alias("exams"), long(F.coalesce("questions", F.lit(0))).alias("questions"))


def q53_upsert(spark, d):
    """Search results by (user, URL): scores replaced (a missing one is 0), new ones added; then what isn't approved among today's URLs."""
    x = exams(spark, d).where("source_url IS NOT NULL AND id % 7 <> 0").groupBy("user_id", "source_url").agg(F.min_by("status", "id").alias("status"), F.min_by("match_score", "id").alias("old"))
    new = exams(spark, d).where("source_url IS NOT NULL AND id % 3 <> 0").groupBy("user_id", "source_url").agg(F.min("id").alias("first")).withColumn("new", F.coalesce(F.when(F.col("first") % 4 == 0, None).otherwise(F.col("first") % 50), F.lit(0)))
    j = x.join(new, ["user_id", "source_url"], "full_outer")
    merged = j.select("user_id", "source_url", F.coalesce("status", F.lit("Pendente")).alias("status"), F.coalesce("new", "old").cast("bigint").alias("match_score"), F.col("new").isNotNull().alias("current"))
    return merged.where("current AND status <> 'Aprovada'").select("user_id", F.substring_index("source_url", "?v=", 1).alias("url"), F.col("source_url").alias("source"), "status", "match_score")


def q54_folders(spark, d):
    """Folders to make for exams by (user, name): names that a user has stay, new ones get the next ids."""
    wanted = exams(spark, d).select("user_id", folder_name(F.when(F.col("id") % 9 == 0, "Prova - .x").otherwise(F.col("title")), F.col("id")).alias("name")).distinct()
    stored = load(spark, d, "customer").select(long("c_custkey").alias("id"), long("c_custkey").alias("user_id"), F.lit("1-URGENT").alias("name"))
    missing = numbered(wanted.join(stored, ["user_id", "name"], "left_anti"), ["user_id", "name"], "n")
    top = stored.agg(F.max("id").alias("top"))
    return stored.unionByName(missing.join(F.broadcast(top)).select((F.col("n") + F.col("top")).cast("bigint").alias("id"), "user_id", "name"))


def q55_reload(spark, d):
    """A table of questions by exam, loaded, added to, and reloaded for some exams; its rows after that."""
    path = own_path(spark, "questions")
    q = load(spark, d, "lineitem").select(long("l_partkey").alias("id"), (F.col("l_orderkey") % 8).cast("bigint").alias("exam_id"), long("l_linenumber").alias("number"), "l_returnflag")
    append(q.where("exam_id < 6").drop("l_returnflag"), path, "exam_id")
    append(q.where("exam_id = 7").drop("l_returnflag"), path, "exam_id")
    for _ in range(2):  # the second time changes nothing
        reload_partitions(q.where("exam_id IN (1, 6) AND l_returnflag = 'R'").drop("l_returnflag"), path, "exam_id")
    return spark.read.schema("id bigint, number bigint, exam_id bigint").parquet(path).groupBy("exam_id").agg(long(F.count(F.lit(1))).alias("n"), long(F.sum("id")).alias("ids"), long(F.max("number")).alias("last"))


def q56_ranking_places(spark, d):
    """The ranking by questions and rounded accuracy; users without questions have no place. Places are counted in ranges."""
    a = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("s"))
    u = load(spark, d, "customer").select(long("c_custkey").alias("user_id"), falsy_coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "Sem nome").alias("name"))
    j = u.join(a, F.col("user_id") == F.col("o_custkey"), "left").select("user_id", "name", long(F.coalesce("t", F.lit(0))).alias("questions"), F.coalesce(F.bround(F.try_divide(F.col("s").cast("double"), "t") * 100, 1), F.lit(0.0)).alias("accuracy"))
    placed = numbered(j.select("*", (-F.col("questions")).alias("__q"), (-F.col("accuracy")).alias("__a")), ["__q", "__a", "user_id"], "n")
    return placed.select("user_id", "name", "questions", "accuracy", F.when(F.col("questions") > 0, F.col("n").cast("string")).otherwise("-").alias("place"))


QUERIES = {f.__name__: f for f in (q48_search, q49_relevance, q50_listing, q51_copies, q52_deleted, q53_upsert, q54_folders, q55_reload, q56_ranking_places)}
_SKIP = "resultado|convoca|retifica|cronograma|edital|rela|resposta|recurso|divulga|homologa|inscri|isen|anexo|aditivo|comunicado|aviso|lista|decreto|lei|portaria|informa|classifica|quantitativo|local|data|nota|judicial|decis|cumprimento|gabarito|preliminar|definitiv|parecer"
ORACLE_SQL = {
    "q48_search": """
WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/[0-9]+(\\.html)?/?$', '/doc.pdf') AS url FROM pages),
t AS (SELECT *, string_split(url, '//')[-1] AS t FROM p),
u AS (
  SELECT * FROM (SELECT 0 AS rank, url, page_id, 'Web - ' || left(t, 60) AS title, CAST(NULL AS BIGINT) AS score FROM t WHERE page_id % 3 <> 1 AND contains(lower(url), '.pdf') ORDER BY page_id LIMIT 8)
  UNION ALL SELECT * FROM (SELECT 1, url, page_id, 'IDCAP - ' || t, CASE WHEN page_id % 4 <> 0 THEN page_id % 97 END FROM t WHERE page_id % 3 <> 2 ORDER BY page_id LIMIT 25)
  UNION ALL SELECT * FROM (SELECT 2, url, page_id, 'PCI - ' || t, page_id % 89 FROM t WHERE page_id % 5 < 3 ORDER BY page_id LIMIT 15)),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, page_id) AS rn FROM u),
s AS (SELECT *, CASE WHEN lower(title) LIKE 'idcap%' OR contains(lower(url), 'idcap') THEN 'idcap' WHEN lower(title) LIKE 'pci%' THEN 'pci' ELSE 'web' END AS source FROM f WHERE rn = 1)
SELECT url, title, CAST(coalesce(score, 0) AS BIGINT) AS score, source, CASE source WHEN 'idcap' THEN 'IDCAP' WHEN 'pci' THEN 'PCI Concursos' ELSE 'Web' END AS label FROM s""",
    "q49_relevance": """
WITH s AS (SELECT * FROM (VALUES (1, ['the', 'analista', 'that', 'and'], 'that and'), (2, CAST([] AS VARCHAR[]), NULL), (3, ['for', 'and', 'the'], NULL), (4, ['xyzzy', 'qwerty'], 'qwerty'), (5, ['and', 'the'], 'and the')) v(search, words, role)),
j AS (SELECT search, item_id, words, role, lower(left(text, 100)) AS t FROM benchmark, s),
h AS (SELECT *, len(words) AS n, len(list_filter(words, lambda w: contains(t, w))) AS hits FROM j),
b AS (SELECT *, CASE WHEN n > 0 THEN hits * 100 // n ELSE 0 END AS base FROM h),
l AS (SELECT *, CASE WHEN role IS NOT NULL AND contains(t, role) THEN least(base + 30, 100) WHEN role IS NULL AND n = 0 THEN 50 ELSE base END AS lifted FROM b)
SELECT CAST(search AS BIGINT) AS search, CAST(item_id AS BIGINT) AS item_id, CAST(CASE WHEN lifted = 0 AND n > 0 THEN 10 ELSE lifted END AS BIGINT) AS score FROM l""",
    "q50_listing": f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>.*?</ul>') AS l FROM pages),
e AS (SELECT page_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS list FROM l),
a AS (SELECT page_id, list, regexp_extract_all(body, '(<a href="[^"]*">[^<]*)</a>', 1) AS l FROM e),
x AS (SELECT page_id, list, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM a),
y AS (SELECT page_id, list, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS link, lower(regexp_extract(a, '>([^<]*)$', 1)) AS name FROM x)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(list AS BIGINT) AS list, CAST(pos AS BIGINT) AS pos, link, name FROM y WHERE NOT regexp_matches(name, '{_SKIP}') ORDER BY page_id, list, pos LIMIT 25""",
    "q51_copies": f"""
WITH {EXAMS}, r AS (SELECT source_url, min(id) AS f FROM x WHERE status = 'Aprovada' AND source_url IS NOT NULL GROUP BY 1)
SELECT x.id AS exam_id, CAST(count(*) AS BIGINT) AS copied, CAST(sum(l_partkey) AS BIGINT) AS questions FROM x JOIN r ON r.source_url = x.source_url JOIN lineitem ON l_orderkey = f WHERE status = 'Pendente' GROUP BY 1""",
    "q52_deleted": f"""
WITH {EXAMS}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT folder_id, count(*) AS had, count(*) FILTER (WHERE status <> 'Negada') AS stay, sum(CASE WHEN status <> 'Negada' THEN coalesce(n, 0) ELSE 0 END) AS q FROM x LEFT JOIN n ON l_orderkey = id WHERE folder_id IS NOT NULL GROUP BY 1)
SELECT CAST(c_custkey AS BIGINT) AS folder_id, CAST(coalesce(stay, 0) AS BIGINT) AS exams, CAST(coalesce(q, 0) AS BIGINT) AS questions FROM customer LEFT JOIN g ON g.folder_id = c_custkey WHERE had IS NULL OR stay > 0""",
    "q53_upsert": f"""
WITH {EXAMS},
s AS (SELECT user_id, source_url, arg_min(status, id) AS status FROM x WHERE source_url IS NOT NULL AND id % 7 <> 0 GROUP BY 1, 2),
n AS (SELECT user_id, source_url, min(id) AS f FROM x WHERE source_url IS NOT NULL AND id % 3 <> 0 GROUP BY 1, 2)
SELECT n.user_id, split_part(n.source_url, '?v=', 1) AS url, n.source_url AS source, coalesce(s.status, 'Pendente') AS status, CAST(CASE WHEN f % 4 = 0 THEN 0 ELSE f % 50 END AS BIGINT) AS match_score
FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.source_url = n.source_url WHERE coalesce(s.status, 'Pendente') <> 'Aprovada'""",
    "q54_folders": f"""
WITH {EXAMS}, w AS (SELECT DISTINCT user_id, CASE WHEN id % 9 = 0 THEN 'Pasta Prova ' || id ELSE left(split_part(replace(title, 'Prova - ', ''), '.', 1), 40) END AS name FROM x),
m AS (SELECT *, row_number() OVER (ORDER BY user_id, name) AS n FROM w WHERE NOT (name = '1-URGENT' AND user_id IN (SELECT c_custkey FROM customer)))
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS user_id, '1-URGENT' AS name FROM customer
UNION ALL SELECT CAST(n + (SELECT max(c_custkey) FROM customer) AS BIGINT), user_id, name FROM m""",
    "q55_reload": """
SELECT CAST(l_orderkey % 8 AS BIGINT) AS exam_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS ids, CAST(max(l_linenumber) AS BIGINT) AS last
FROM lineitem WHERE l_orderkey % 8 IN (0, 2, 3, 4, 5, 7) OR l_orderkey % 8 IN (1, 6) AND l_returnflag = 'R' GROUP BY 1""",
    "q56_ranking_places": """
WITH a AS (SELECT o_custkey, count(*) AS t, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
j AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Sem nome') AS name, CAST(coalesce(t, 0) AS BIGINT) AS questions, coalesce(round_even(CAST(s AS DOUBLE) / t * 100, 1), 0.0) AS accuracy FROM customer LEFT JOIN a ON o_custkey = c_custkey)
SELECT *, CASE WHEN questions > 0 THEN CAST(row_number() OVER (ORDER BY questions DESC, accuracy DESC, user_id) AS VARCHAR) ELSE '-' END AS place FROM j""",
}
