"""Records as they come from outside: numbers in texts, asked pages, users, older layouts, stored files, download links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.semantics import long
from quillon.operators.intake import number_of
from quillon.operators.library import numbered
from quillon.sources import load
from quillon.sources.pdf import is_pdf
from quillon.sources.sinks import evolved, land_files, own_path

# Fixed values of the product: where a site keeps the files of its pages, and what its links say.
DOWNLOADS, ACTION, ANSWERS = "https://www.pciconcursos.com.br/download/", "baixar", "gabarito"
#: Mean characters of a page below which a text is too thin to read.
THIN = 80


def gaps_of(rows: DataFrame, exam: str, number: str) -> DataFrame:
    """(exam, top, missing): the largest number that the texts hold, and the numbers below it that none holds. Zero and texts without digits don't count."""
    n = rows.select(exam, number_of(F.col(number)).alias("n")).where("n > 0")
    g = n.groupBy(exam).agg(F.max("n").alias("top"), F.collect_set("n").alias("seen"))
    return g.select(exam, "top", F.array_sort(F.array_except(F.sequence(F.lit(1), "top"), "seen")).alias("missing"))


def q90_parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The largest question number of each order's lines, and the ones that are missing, from numbers as they are written."""
    n = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("Questão nº "), n)).when(F.col("l_partkey") % 5 == 1, F.concat(F.lit(" 0"), n, F.lit("."))).when(F.col("l_partkey") % 5 == 2, "sem número").when(F.col("l_partkey") % 5 == 3, n).otherwise("0")
    g = gaps_of(load(spark, d, "lineitem").select(long("l_orderkey").alias("order_id"), text.alias("text")), "order_id", "text")
    return g.select("order_id", long("top").alias("top"), F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


def density(pages: DataFrame, exam: str) -> DataFrame:
    """For each exam of pages (exam, text, has_image): pages, mean characters with runs of spaces as one and line ends between pages, and why it needs eyes: thin, images or not at all."""
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), " {2,}", " "))
    g = pages.groupBy(exam).agg(F.count(F.lit(1)).alias("pages"), ((F.sum(size) + F.count(F.lit(1)) - 1) / F.count(F.lit(1))).alias("mean"), F.bool_or("has_image").alias("images"))
    return g.select(exam, long("pages").alias("pages"), F.bround("mean", 3).alias("chars_a_page"), F.when(F.col("mean") < THIN, "thin").when(F.col("images"), "images").otherwise("text").alias("seen_as"))


def page_folder(spark: SparkSession, d: str, at: str | None = None, parts: int = 16) -> DataFrame:
    """Turns as pages of exams, in a folder for each part of the exams."""
    at = at or own_path(spark, "pages")
    text = F.when(F.col("conv_id") % 3 == 0, F.left("text", F.lit(40))).otherwise(F.replace("text", F.lit(". "), F.lit(".   ")))
    pages = load(spark, d, "conversations").select(long("conv_id").alias("exam"), long("turn").alias("page"), text.alias("text"), ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("has_image"), (F.col("conv_id") % parts).cast("int").alias("part"))
    pages.write.mode("overwrite").partitionBy("part").parquet(at)
    return spark.read.schema(pages.schema).parquet(at)


def asked_pages(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Pages of the exams (exam, part) that are asked for; only their parts' files are read."""
    return pages.join(F.broadcast(asked.select("exam", "part").distinct()), ["exam", "part"])


def q91_asked_pages(spark: SparkSession, d: str) -> DataFrame:
    """How readable the pages of the exams are that customers ask for."""
    asked = load(spark, d, "customer").where("c_custkey % 16 IN (3, 7)").select(long("c_custkey").alias("exam"), (F.col("c_custkey") % 16).cast("int").alias("part"))
    return density(asked_pages(page_folder(spark, d), asked), "exam")


def signed_in(users: DataFrame, infos: DataFrame) -> DataFrame:
    """Users (id, google_id, email, name, picture) after sign-ins (google_id, email, name, picture), one for each id at most.

    Known users get the name and picture that came, also where these are null, and keep their email; new ones get the next ids.
    """
    i = infos.select("google_id", *(F.col(c).alias(f"i_{c}") for c in ("email", "name", "picture")), F.lit(True).alias("came"))
    known = users.join(i, "google_id", "left")
    value = lambda c: F.when(F.col("came"), F.col(f"i_{c}")).otherwise(F.col(c)).alias(c)
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    new = numbered(infos.join(users, "google_id", "left_anti"), ["google_id"], "k").join(F.broadcast(top))
    stays = known.select("id", "google_id", "email", value("name"), value("picture"))
    return stays.unionByName(new.select((F.col("top") + F.col("k")).cast(users.schema["id"].dataType).alias("id"), "google_id", "email", "name", "picture"))


def q92_signed_in(spark: SparkSession, d: str) -> DataFrame:
    """Users after sign-ins of half of the customers."""
    c = load(spark, d, "customer").withColumn("google_id", F.concat(F.lit("g"), F.col("c_custkey").cast("string")))
    users = c.where("c_custkey % 3 <> 0").select(long("c_custkey").alias("id"), "google_id", F.concat("c_name", F.lit("@old")).alias("email"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("picture"))
    infos = c.where("c_custkey % 2 = 0").select("google_id", F.concat("c_name", F.lit("@new")).alias("email"), F.when(F.col("c_custkey") % 4 != 0, F.upper("c_name")).alias("name"), F.col("c_mktsegment").alias("picture"))
    return signed_in(users, infos)


def q93_evolved(spark: SparkSession, d: str) -> DataFrame:
    """Exams of an older layout in today's: new columns with their defaults, columns that are no more left out."""
    old = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", "Aprovada").alias("status"), F.col("o_custkey").alias("folder_id"), F.col("o_totalprice").alias("price"))
    return evolved(old, "exams")


def stored(spark: SparkSession, folder: str, exam: str, pattern: str = "*", least_bytes: int = 1000) -> DataFrame:
    """(exam, bytes) of the exams that have a file of more than ``least_bytes``: one in their folder (``exam=7/a.pdf``) or, where no folders are theirs, one with their number first in its name (``7_a.pdf``); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).where(F.col("length") > least_bytes)
    if exam in files.columns:
        files = files.withColumn(exam, F.col(exam).cast("bigint"))
    else:
        files = files.withColumn(exam, F.regexp_extract("path", r"/(0|-?[1-9][0-9]*)_[^/]*$", 1).try_cast("bigint")).where(F.col(exam).isNotNull())
    return files.groupBy(exam).agg(F.max("length").alias("bytes"))


def exam_files(spark: SparkSession, d: str, at: str | None = None, together: int = 1000) -> str:
    """The folder that suppliers, as exams, have a file each in."""
    at = at or own_path(spark, "files")
    exams = load(spark, d, "supplier").select(F.col("s_suppkey").alias("exam"))
    land_files(exams, at, "exam", F.repeat(F.lit("x"), (F.col("exam") % 25 * 100).cast("int")), together)
    return at


def q94_stored_files(spark: SparkSession, d: str) -> DataFrame:
    """Which exams' files can be used again: those over 1000 bytes."""
    return stored(spark, exam_files(spark, d), "exam", "*.txt")


def download_link(html: Column, url: Column) -> Column:
    """Where a page's file is: its first link to download that is no answer sheet, with its token; the page's own address without one."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    at = lambda tag, name: F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    usable = lambda a: (at(a, "data-arquivo") != "") & (at(a, "data-code") != "") & (at(a, "data-acao") == ACTION) & ~F.contains(F.lower(at(a, "data-arquivo")), F.lit(ANSWERS))
    first = F.get(F.filter(links, usable), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit(DOWNLOADS), at(first, "data-arquivo"), F.lit("?token="), at(first, "data-code"))).otherwise(url)


def q95_downloads(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages to their files, and whether what came for them is a PDF by its type or its first bytes."""
    p = load(spark, d, "pages")
    html = F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(F.replace(F.replace("html", F.lit('<a href="'), F.lit('<a data-acao="baixar" data-code="t1" data-arquivo="')), F.lit('data-arquivo="https'), F.lit('data-arquivo="gabarito-https')))
    sent = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "url")).otherwise(F.col("url")).cast("binary")
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf; v=1").when(F.col("page_id") % 3 == 1, "text/html")
    return p.select(long("page_id").alias("page_id"), download_link(html, F.col("url")).alias("link"), is_pdf(sent, kind).alias("pdf"))


QUERIES = {f.__name__: f for f in (q90_parsed_numbers, q91_asked_pages, q92_signed_in, q93_evolved, q94_stored_files, q95_downloads)}
ORACLE_SQL = {
    "q90_parsed_numbers": """
WITH l AS (SELECT l_orderkey AS o, CASE l_partkey % 5 WHEN 0 THEN 'Questão nº ' || l_linenumber WHEN 1 THEN ' 0' || l_linenumber || '.' WHEN 2 THEN 'sem número' WHEN 3 THEN CAST(l_linenumber AS VARCHAR) ELSE '0' END AS t FROM lineitem),
n AS (SELECT DISTINCT o, TRY_CAST(regexp_replace(t, '[^0-9]', '', 'g') AS INTEGER) AS n FROM l), g AS (SELECT o, max(n) AS top, list(n) AS seen FROM n WHERE n > 0 GROUP BY 1)
SELECT CAST(o AS BIGINT) AS order_id, CAST(top AS BIGINT) AS top, array_to_string(list_filter(range(1, top + 1), lambda i: NOT list_contains(seen, i)), ',') AS missing FROM g""",
    "q91_asked_pages": f"""
WITH p AS (SELECT conv_id AS exam, length(regexp_replace(coalesce(CASE WHEN conv_id % 3 = 0 THEN left(text, 40) ELSE replace(text, '. ', '.   ') END, ''), ' {{2,}}', ' ', 'g')) AS n, (conv_id + turn) % 11 = 0 AS i FROM conversations),
g AS (SELECT exam, count(*) AS pages, (sum(n) + count(*) - 1) / count(*) AS mean, bool_or(i) AS images FROM p WHERE exam IN (SELECT c_custkey FROM customer WHERE c_custkey % 16 IN (3, 7)) GROUP BY 1)
SELECT CAST(exam AS BIGINT) AS exam, pages, round_even(mean, 3) AS chars_a_page, CASE WHEN mean < {THIN} THEN 'thin' WHEN images THEN 'images' ELSE 'text' END AS seen_as FROM g""",
    "q92_signed_in": """
WITH u AS (SELECT CAST(c_custkey AS BIGINT) AS id, 'g' || c_custkey AS google_id, c_name || '@old' AS email, c_name AS name FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT 'g' || c_custkey AS google_id, c_name || '@new' AS email, CASE WHEN c_custkey % 4 <> 0 THEN upper(c_name) END AS name, c_mktsegment AS picture FROM customer WHERE c_custkey % 2 = 0)
SELECT id, u.google_id, u.email, CASE WHEN i.google_id IS NULL THEN u.name ELSE i.name END AS name, i.picture FROM u LEFT JOIN i USING (google_id)
UNION ALL SELECT CAST((SELECT max(id) FROM u) + row_number() OVER (ORDER BY google_id) AS BIGINT), * FROM i WHERE google_id NOT IN (SELECT google_id FROM u)""",
    "q93_evolved": """
SELECT CAST(o_orderkey AS INTEGER) AS id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN 'Aprovada' END AS status, CAST(o_custkey AS INTEGER) AS folder_id, CAST(NULL AS INTEGER) AS user_id, CAST(NULL AS VARCHAR) AS source_url, CAST(0 AS INTEGER) AS match_score FROM orders""",
    "q94_stored_files": "SELECT CAST(s_suppkey AS BIGINT) AS exam, CAST(s_suppkey % 25 * 100 + 1 AS BIGINT) AS bytes FROM supplier WHERE s_suppkey % 25 * 100 + 1 > 1000",
    "q95_downloads": """
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 4 <> 0 THEN list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda l: l <> '' AND NOT starts_with(l, 'https') AND NOT contains(lower(l), 'gabarito')) ELSE [] END AS links FROM pages)
SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN len(links) > 0 THEN 'https://www.pciconcursos.com.br/download/' || links[1] || '?token=t1' ELSE url END AS link, page_id % 5 = 0 OR page_id % 3 = 0 AS pdf FROM p""",
}
