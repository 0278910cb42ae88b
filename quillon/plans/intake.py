"""Extraction of questions: titles, versions, gaps that heal, pages, images; on parts, lines and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.semantics import long
from quillon.operators.intake import best_versions, heal, image_places, number_order, standard_title
from quillon.plans.library import EXAMS, exams
from quillon.sources import load
from quillon.sources.loads import spread


def q57_titles(spark, d, most: int = 20_000):
    """Titles of parts, with notices, repeated parts and boards around them, in standard form."""
    p, k = spread(load(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_brand"), most), F.col("p_partkey") % 6
    title = (
        F.when(k == 0, F.concat(F.lit("Provas para download - IDCAP — "), "p_type", F.lit(" - "), F.lower("p_type"), F.lit(" - "), "p_name"))
        .when(k == 1, F.concat(F.lit("Prova - Edital nº 12/2019 de 3 de março de 2019 - "), "p_name", F.lit(" - 001/2020 - "), "p_brand"))
        .when(k == 2, F.concat("p_brand", F.lit(" - Processo Seletivo Privado - "), "p_name", F.lit(" ( - )")))
        .when(k == 3, F.concat("p_name", F.lit(" 2021 - "), "p_type", F.lit(" - 1ª Nota Pública de 2022")))
        .when(k == 4, F.lit("Prova - "))
        .otherwise(F.concat(F.lit("PCI - "), "p_name", F.lit(" – "), "p_type", F.lit(" -- "), F.upper("p_name")))
    )
    url = F.when(F.col("p_partkey") % 4 == 0, "http://h/2017/x.pdf").otherwise("http://h/x.pdf")
    board = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).when(F.col("p_partkey") % 5 == 1, "N/A").when(F.col("p_partkey") % 5 == 2, "Companhia de Portos")
    place = F.when(F.col("p_partkey") % 7 == 0, "Vila Velha").when(F.col("p_partkey") % 7 == 1, "Portos")
    year = F.when(F.col("p_partkey") % 3 == 0, "2015").when(F.col("p_partkey") % 3 == 1, "n/a")
    return p.select(long("p_partkey").alias("id"), standard_title(title, url, board, place, year).alias("title"))


def q58_versions(spark, d):
    """Lines as versions of the questions of orders: fold of options, length and images, in order of numbers."""
    li = load(spark, d, "lineitem")
    some = lambda n: F.map_from_entries(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("o"), i.cast("string")), F.lit("x"))))
    n = (F.col("l_quantity") % 4).cast("int")
    body = F.concat(F.repeat(F.lit("q"), (F.col("l_partkey") % 9).cast("int") + 3), F.when(F.col("l_returnflag") == "R", " (Gabarito: B)").otherwise(""))
    rows = li.select(
        long("l_orderkey").alias("exam_id"), F.concat(F.lit(" "), F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_linenumber").cast("string"))).alias("numero_questao"), body.alias("enunciado"),
        F.when(n > 0, some(F.greatest(n, F.lit(1)))).alias("opcoes"), F.lit(None).cast("string").alias("resposta"), F.lit(None).cast("string").alias("disciplina"),
        F.when(F.col("l_partkey") % 3 == 0, F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("images"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    b = best_versions(rows)
    return b.select("exam_id", "numero_questao", long(number_order(F.col("numero_questao"))).alias("place"), "statement", F.array_join(F.array_sort("images"), ",").alias("images"), long(F.size(F.from_json("options", "map<string,string>"))).alias("options"), long("seq.l_partkey").alias("part"), "correct_answer", "subject", long("versions").alias("versions"))


def q59_heal(spark, d):
    """Numbers that are missing from orders, and those that two rounds of extraction in batches of five leave."""
    g = load(spark, d, "lineitem").groupBy(long("l_orderkey").alias("exam_id")).agg(F.collect_set(long("l_linenumber")).alias("seen"))
    gaps = g.select("exam_id", F.posexplode(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.array_max("seen")), "seen")).alias("i", "number")).select("exam_id", "number", F.floor(F.col("i") / 5).cast("bigint").alias("batch"))
    left = heal(gaps, lambda m, k: m.where((F.col("exam_id") + F.col("number")) % 3 == k), ["exam_id", "number"])
    return gaps.join(left.select("exam_id", "number", F.lit(True).alias("left")), ["exam_id", "number"], "left").groupBy("exam_id").agg(long(F.count(F.lit(1))).alias("gaps"), long(F.count("left")).alias("left"), F.when(F.count("left") > 0, "validation_failed").otherwise("ok").alias("state"))


def q60_images(spark, d):
    """Lines as boxes and questions on the pages of orders: which question each box of images belongs to."""
    li = load(spark, d, "lineitem")
    page = [F.col("l_orderkey") % 200, F.floor(F.col("l_orderkey") / 200).cast("bigint")]
    exam_page = [long(page[0]).alias("exam"), page[1].alias("page")]
    x0, y0 = (F.col("l_suppkey") % 3) * 250.0, (F.col("l_partkey") * 37 % 960) * 1.0
    w, h = (F.col("l_partkey") % 40) * 10.0, (F.col("l_quantity") - 1) * 4
    boxes = li.where("l_returnflag <> 'N'").select(*exam_page, x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))
    marks = li.where("l_linenumber = 1").select(*exam_page, F.lit(400.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(480.0).alias("x1"), F.lit(560.0).alias("y1"))
    q = li.where("l_returnflag = 'N'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    q = q.select(*exam_page, long(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"), ((F.col("p") % 2) * 300.0 + 20).alias("x"), (F.col("p") * 53 % 900 + 50.0).alias("y"))
    r = image_places(boxes.unionByName(marks), q)
    return r.select("exam", "page", long("gap").alias("gap"), "x0", "y0", "x1", "y1", "index")


def q61_pages(spark, d):
    """Chunks of three pages, two apart, without blank ones; mean characters a page, and whether the text is too thin to read."""
    t = F.when(F.col("turn") % 3 == 2, "  ").when(F.col("conv_id") % 4 == 0, F.left("text", F.lit(30))).otherwise(F.regexp_replace("text", " {2,}", " "))
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", t.alias("t")))).alias("p"))
    n = F.size("p")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - 3) / F.lit(2)), F.lit(0)).cast("int") * 2, F.lit(2))
    e = c.select("conv_id", (F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x["t"])) / F.greatest(n, F.lit(1))).alias("mean"), F.posexplode(F.transform(starts, lambda i: F.slice("p", i + 1, 3))).alias("chunk", "c"))
    filled = e.where(F.exists("c", lambda x: F.trim(x["t"]) != ""))
    return filled.select(long("conv_id").alias("conv_id"), long("chunk").alias("chunk"), F.bround("mean", 3).alias("chars_a_page"), (F.col("mean") < 80).alias("thin"), F.array_join(F.transform("c", lambda x: x["turn"].cast("string")), ",").alias("turns"))


def q62_repaired(spark, d):
    r"""JSON out of fences, with stray backslashes made good: texts that parse, and what stands in them."""
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("```json\n{\"t\": \"a\\d"), "event_type", F.when(F.col("event_id") % 5 == 0, "").otherwise('"}'), F.lit("\n```")).alias("raw"))
    body = F.regexp_replace(F.regexp_replace("raw", r"^```(?:json)?\s*", ""), r"\s*```$", "")
    fixed = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return e.select(long("event_id").alias("event_id"), F.from_json(fixed, "map<string,string>")["t"].alias("t"))


def q63_error_class(spark, d):
    """Errors by what their messages say, and how a run ends on them."""
    e = load(spark, d, "events").where("event_type IN ('error', 'view')").select("event_id", F.concat(F.when(F.col("event_id") % 5 == 0, "HTTP 429 Too Many").when(F.col("event_id") % 5 == 1, "Resource Exhausted").when(F.col("event_id") % 5 == 2, "401 unauthorised").when(F.col("event_id") % 5 == 3, "model Not Found").otherwise("torn"), F.lit(" at "), F.col("event_id").cast("string")).alias("m"))
    has = lambda *words: F.exists(F.lit(list(words)), lambda w: F.contains("m", w))
    quota = has("429", "Quota") | F.contains(F.lower("m"), F.lit("exhausted"))
    return e.select(long("event_id").alias("event_id"), F.when(quota, "429").when(has("401", "PermissionDenied"), "401").otherwise("other").alias("key_error"), F.when(quota, "quota_exceeded").when(has("404") | F.contains(F.lower("m"), F.lit("not found")), "model_not_found").otherwise("unknown").alias("exam_error"), F.left("m", F.lit(60)).alias("shown"))


def q64_exam_view(spark, d):
    """Each approved exam with its questions in order, as JSON."""
    x = exams(spark, d).where("status = 'Aprovada'")
    q = load(spark, d, "lineitem").groupBy(long("l_orderkey").alias("exam_id"), long("l_linenumber").alias("number")).agg(long(F.min("l_partkey")).alias("part"))
    g = q.groupBy("exam_id").agg(F.sort_array(F.collect_list(F.struct("number", "part"))).alias("questions"))
    return x.join(g, F.col("id") == F.col("exam_id"), "left").select("id", F.to_json(F.struct("id", "title", F.coalesce("questions", F.array()).alias("questions"))).alias("exam"))


QUERIES = {f.__name__: f for f in (q57_titles, q58_versions, q59_heal, q60_images, q61_pages, q62_repaired, q63_error_class, q64_exam_view)}
ORACLE_SQL = {
    "q57_titles": """
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_type AS t, p_brand AS b FROM part),
y AS (SELECT k, CASE k % 6
    WHEN 0 THEN t || ' - ' || n
    WHEN 1 THEN n || ' - ' || b
    WHEN 2 THEN b || ' - ' || n
    WHEN 3 THEN n || ' 2021 - ' || t
    WHEN 4 THEN 'Geral / Conhecimentos Básicos'
    ELSE n || ' - ' || t END AS role,
  CASE k % 6 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS kind, n, t, b,
  CASE WHEN k % 6 = 1 THEN '2019' WHEN k % 6 = 3 THEN '2021' WHEN k % 4 = 0 THEN '2017' WHEN k % 3 = 0 THEN '2015' ELSE '' END AS year,
  CASE k % 5 WHEN 0 THEN b WHEN 2 THEN 'Companhia de Portos' ELSE '' END AS board,
  CASE k % 7 WHEN 0 THEN 'Vila Velha' WHEN 1 THEN 'Portos' ELSE '' END AS place FROM p),
w AS (SELECT *, CASE WHEN place <> '' AND contains(lower(board), lower(place)) THEN '' ELSE place END AS spot,
  CASE WHEN board <> '' AND k % 6 = 2 AND k % 5 = 0 THEN n ELSE role END AS rest FROM y),
f AS (SELECT k, year, list_filter(list_transform(string_split(upper(CASE WHEN board <> '' THEN board || CASE WHEN spot <> '' THEN ' - ' || spot ELSE '' END || ' - ' WHEN spot <> '' THEN spot || ' - ' ELSE '' END || rest), '-'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM w),
r AS (SELECT k, year, list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN contains(regexp_replace(lower(a[-1]), '[^\\p{L}\\p{N}_]', '', 'g'), regexp_replace(lower(x[1]), '[^\\p{L}\\p{N}_]', '', 'g')) OR contains(regexp_replace(lower(x[1]), '[^\\p{L}\\p{N}_]', '', 'g'), regexp_replace(lower(a[-1]), '[^\\p{L}\\p{N}_]', '', 'g')) THEN a ELSE list_concat(a, x) END) AS kept FROM f)
SELECT CAST(k AS BIGINT) AS id, CASE WHEN year <> '' THEN '[' || year || '] ' ELSE '' END || array_to_string(kept, ' - ') AS title FROM r""",
    "q58_versions": """
WITH v AS (SELECT l_orderkey AS e, CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS num, l_partkey AS p, l_suppkey AS s, l_extendedprice AS pr, CAST(l_quantity AS BIGINT) % 4 AS o,
  CAST(l_partkey % 9 + 3 AS BIGINT) AS kept, CAST(l_partkey % 9 + 3 + CASE WHEN l_returnflag = 'R' THEN 14 ELSE 0 END AS BIGINT) AS raw, CASE WHEN l_partkey % 3 = 0 THEN ['p' || l_partkey] ELSE CAST([] AS VARCHAR[]) END AS i FROM lineitem),
g AS (SELECT e, num, list({'o': o, 'raw': raw, 'kept': kept, 'p': p, 'i': i} ORDER BY p, s, pr) AS l, count(*) AS n FROM v GROUP BY 1, 2),
r AS (SELECT e, num, n, list_reduce(l, lambda a, x: CASE WHEN x.o > a.o OR x.o = a.o AND x.raw > a.kept THEN {'o': x.o, 'raw': x.raw, 'kept': x.kept, 'p': x.p, 'i': list_concat(a.i, x.i)} ELSE {'o': a.o, 'raw': a.raw, 'kept': a.kept, 'p': a.p, 'i': list_concat(a.i, x.i)} END) AS b FROM g)
SELECT CAST(e AS BIGINT) AS exam_id, num AS numero_questao, CAST(CASE WHEN num = 'x' THEN 999999 ELSE CAST(num AS BIGINT) END AS BIGINT) AS place, repeat('q', b.kept) AS statement, coalesce(array_to_string(list_sort(list_distinct(b.i)), ','), '') AS images,
  CASE WHEN b.o > 0 THEN CAST(b.o AS BIGINT) END AS options, CAST(b.p AS BIGINT) AS part, 'A' AS correct_answer, 'Geral' AS subject, CAST(n AS BIGINT) AS versions FROM r""",
    "q59_heal": """
WITH m AS (SELECT l_orderkey AS e, max(l_linenumber) AS m FROM lineitem GROUP BY 1), s AS (SELECT e, unnest(range(1, m + 1)) AS n FROM m),
g AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = e AND l.l_linenumber = n))
SELECT CAST(e AS BIGINT) AS exam_id, CAST(count(*) AS BIGINT) AS gaps, CAST(count(*) FILTER (WHERE (e + n) % 3 = 2) AS BIGINT) AS left, CASE WHEN count(*) FILTER (WHERE (e + n) % 3 = 2) > 0 THEN 'validation_failed' ELSE 'ok' END AS state FROM g GROUP BY 1""",
    "q60_images": """
WITH li AS (SELECT *, CAST(l_orderkey % 200 AS BIGINT) AS exam, CAST(l_orderkey // 200 AS BIGINT) AS page FROM lineitem),
im AS (SELECT exam, page, l_suppkey % 3 * 250.0::DOUBLE AS x0, (l_partkey * 37 % 960)::DOUBLE AS y0, l_suppkey % 3 * 250.0::DOUBLE + (l_partkey % 40) * 10 AS x1, (l_partkey * 37 % 960)::DOUBLE + (l_quantity - 1) * 4 AS y1 FROM li WHERE l_returnflag <> 'N'
  UNION ALL SELECT exam, page, 400.0, 500.0, 480.0, 560.0 FROM li WHERE l_linenumber = 1),
gr AS (SELECT *, round_even(x0 / 10, 0) AS a, round_even(y0 / 10, 0) AS b, round_even(x1 / 10, 0) AS c, round_even(y1 / 10, 0) AS d FROM im),
bx AS (SELECT DISTINCT exam, page, x0, y0, x1, y1 FROM (SELECT *, count(*) OVER (PARTITION BY exam, a, b, c, d) AS n FROM gr) WHERE n <= 2 AND (y0 + y1) / 2 BETWEEN 100 AND 900),
q0 AS (SELECT exam, page, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS idx, min(l_partkey) AS p FROM li WHERE l_returnflag = 'N' GROUP BY exam, page, l_orderkey, l_linenumber),
q AS (SELECT exam, page, idx, p % 2 * 300.0::DOUBLE + 20 AS x, (p * 53 % 900 + 50)::DOUBLE AS y FROM q0),
o AS (SELECT *, row_number() OVER w AS n, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY exam, page ORDER BY y, x, idx)),
gp AS (SELECT exam, page, n AS gap, greatest(100, coalesce(py + 20, 100)) AS low, y AS high, false AS tail FROM o WHERE y > greatest(100, coalesce(py + 20, 100)) + 20
  UNION ALL SELECT b.exam, b.page, coalesce(max(n), 0) + 1, greatest(100, coalesce(max(y) + 20, 100)), 900, true FROM (SELECT DISTINCT exam, page FROM bx) b LEFT JOIN o ON o.exam = b.exam AND o.page = b.page GROUP BY 1, 2),
mt AS (SELECT bx.*, gap, tail, row_number() OVER (PARTITION BY bx.exam, bx.page, x0, y0, x1, y1 ORDER BY gap) AS rn FROM bx JOIN gp ON gp.exam = bx.exam AND gp.page = bx.page WHERE y0 < high - 10 AND y1 > low + 10),
jt AS (SELECT exam, page, gap, tail, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM mt WHERE rn = 1 GROUP BY ALL),
ok AS (SELECT * FROM jt WHERE (x1 - x0) * (y1 - y0) >= 400 AND (x1 - x0) / nullif(y1 - y0, 0) BETWEEN 0.1 AND 10),
pk AS (SELECT k.exam, k.page, k.gap, k.tail, k.x0, k.y0, k.x1, k.y1, coalesce(bool_or(abs(x - x0) < 200), false) AS col,
  arg_max(idx, (y, -n)) FILTER (WHERE abs(x - x0) < 200 AND y < (y0 + y1) / 2) AS above_same, arg_max(idx, (y, -n)) FILTER (WHERE y < (y0 + y1) / 2) AS above_any, arg_max(idx, (y, -n)) FILTER (WHERE x < x0 - 100) AS lft,
  arg_min(idx, n) FILTER (WHERE abs(x - x0) < 200) AS first_same, arg_min(idx, n) AS first_any, arg_max(idx, n) FILTER (WHERE abs(x - x0) < 200) AS last_same, arg_max(idx, n) AS last_any,
  (SELECT max(idx) FROM q z WHERE z.exam = k.exam AND z.page < k.page) AS before
  FROM ok k LEFT JOIN o ON o.exam = k.exam AND o.page = k.page GROUP BY ALL)
SELECT exam, page, CAST(gap AS BIGINT) AS gap, x0, y0, x1, y1, index FROM (SELECT *, CASE WHEN tail THEN coalesce(CASE WHEN col THEN last_same ELSE last_any END, before)
  ELSE coalesce(CASE WHEN col THEN above_same ELSE above_any END, lft, before, CASE WHEN col THEN first_same ELSE first_any END) END AS index FROM pk) WHERE index IS NOT NULL""",
    "q61_pages": """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '  ' WHEN conv_id % 4 = 0 THEN left(text, 30) ELSE regexp_replace(text, ' {2,}', ' ', 'g') END AS t FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(t)) OVER (PARTITION BY conv_id) / count(*) OVER (PARTITION BY conv_id) AS mean FROM t),
c AS (SELECT conv_id, n, mean, unnest(range(0, CAST(greatest(ceil((n - 3) / 2.0), 0) AS BIGINT) + 1)) AS k FROM (SELECT DISTINCT conv_id, n, mean FROM o))
SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(k AS BIGINT) AS chunk, round_even(c.mean, 3) AS chars_a_page, c.mean < 80 AS thin, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY i) AS turns
FROM c JOIN o ON o.conv_id = c.conv_id AND i >= 2 * k AND i < 2 * k + 3 GROUP BY c.conv_id, k, c.mean HAVING bool_or(trim(t) <> '')""",
    "q62_repaired": r"""
WITH r AS (SELECT event_id, '```json' || chr(10) || '{"t": "a\d' || event_type || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"}' END || chr(10) || '```' AS raw FROM events),
b AS (SELECT event_id, regexp_replace(regexp_replace(raw, '^```(json)?\s*', ''), '\s*```$', '') AS body FROM r),
f AS (SELECT event_id, regexp_replace(body, '\\([^"\\/bfnrtu])', '\\\\\1', 'g') AS fixed FROM b)
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN json_valid(fixed) THEN json_extract_string(fixed, '$.t') END AS t FROM f""",
    "q63_error_class": """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'HTTP 429 Too Many' WHEN 1 THEN 'Resource Exhausted' WHEN 2 THEN '401 unauthorised' WHEN 3 THEN 'model Not Found' ELSE 'torn' END || ' at ' || event_id AS m
  FROM events WHERE event_type IN ('error', 'view')),
q AS (SELECT *, contains(m, '429') OR contains(m, 'Quota') OR contains(lower(m), 'exhausted') AS quota FROM e)
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN quota THEN '429' WHEN contains(m, '401') OR contains(m, 'PermissionDenied') THEN '401' ELSE 'other' END AS key_error,
  CASE WHEN quota THEN 'quota_exceeded' WHEN contains(m, '404') OR contains(lower(m), 'not found') THEN 'model_not_found' ELSE 'unknown' END AS exam_error, left(m, 60) AS shown FROM q""",
    "q64_exam_view": f"""
WITH {EXAMS}, q AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, string_agg('{{"number":' || n || ',"part":' || p || '}}', ',' ORDER BY n) AS l FROM q GROUP BY 1)
SELECT id, '{{"id":' || id || ',"title":"' || title || '","questions":[' || coalesce(l, '') || ']}}' AS exam FROM x LEFT JOIN g ON l_orderkey = id WHERE status = 'Aprovada'""",
}
