"""Extracted questions: titles, versions, order; images and the questions that they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.semantics import unicode_trim

_NONE = ("n/a", "null", "")
#: What is cut from titles, in this order; all but the first two without case.
TITLE_CUTS = (
    (r"(?iu)^(?:provas para download|prova para download|provas?)\s*-\s*", ""),
    (r"(?iu)^(?:IDCAP|IDECAN|PCI|QConcursos)\s*-\s*", ""),
    (r"(?iu)(?:processo seletivo(?:\s*privado|\s*priv|\s*pri)*)+", ""),
    (r"(?iu)concurso\s*p[uú]blico.*?(?:para|-|\s|$)", ""),
    (r"(?iu)psp\s*\d+/\d+\s*-\s*ogmo/s\s*-\s*", ""),
    (r"\d{3}/\d{4}\s*-\s*", ""),
    (r"(?iu)\(?(?:edital|edt\.?)\s*(?:cbmmg)?\s*(?:nº)?\s*\d+(?:[./]\d+)?(?:.*?de\s*\d+\s*de\s*[a-zç]+\s*de\s*\d+)?\)?", ""),
    (r"\(\s*-\s*\)|\(\s*\)", ""),
    (r"(?iu)1ª Nota Pública.*", ""),
    (r"(?iu)Cumprimento de decis.*", ""),
)
ANSWER_TAG = r"(?iu)\(?\s*(?:Correta|Gabarito|Resposta)\s*:\s*[A-E]\s*\)?"


def _parts(text: Column) -> Column:
    """Trimmed, non-empty parts between hyphens."""
    return F.filter(F.transform(F.split(text, "-"), unicode_trim), lambda p: p != "")


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[^\w]", ""))


def _holds(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _known(value: Column) -> Column:
    """The value, empty where it is null or says that there is none."""
    text = F.coalesce(unicode_trim(value), F.lit(""))
    return F.when(F.lower(text).isin(*_NONE), "").otherwise(text)


def _named(value: Column, then) -> Column:
    """``then`` of the value, which is computed once a row however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def standard_title(title: Column, url: Column, board: Column, place: Column, year: Column) -> Column:
    """A title as ``[year] BOARD - PLACE - ROLE``: notices cut away, repeated parts once."""
    none = F.array().cast("array<string>")
    spaced = lambda t: unicode_trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " "), r"\s+", " "))
    year_in = lambda t: F.regexp_extract(t, r"\b(19\d{2}|20\d{2})\b", 1)
    given = lambda seen: F.when(seen != "", F.concat(F.lit("["), seen, F.lit("] "))).otherwise("")

    def head(board: Column, place: Column) -> Column:
        where = F.when((place == "") | F.contains(F.lower(board), F.lower(place)), "").otherwise(place)
        return F.when(board != "", F.concat(board, F.when(where != "", F.concat(F.lit(" - "), where)).otherwise(""), F.lit(" - "))).when(where != "", F.concat(where, F.lit(" - "))).otherwise("")

    def rest(board: Column, once: Column) -> Column:
        """A first part that names the board is left out, if others follow."""
        named = _named(spaced(F.get(once, F.lit(0))), lambda a: _named(spaced(board), lambda b: _holds(a, b)))
        return F.when((board != "") & (F.size(once) > 1) & named, F.slice(once, F.lit(2), F.greatest(F.size(once) - 1, F.lit(1)))).otherwise(once)

    def kept(a: Column, p: Column) -> Column:
        held = _named(_plain(p), lambda x: _named(_plain(F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))), lambda y: _holds(x, y)))
        return F.when((F.size(a) > 0) & held, a).otherwise(F.array_append(a, p))

    text = reduce(lambda t, cut: F.regexp_replace(t, *cut), TITLE_CUTS, F.regexp_replace(title, "[—–]", "-"))
    text = F.regexp_replace(F.btrim(text, F.lit(" -")), r"\s*-\s*-\s*", " - ")
    once = F.aggregate(_parts(text), none, lambda a, p: F.when(F.exists(a, lambda q: F.lower(q) == F.lower(p)), a).otherwise(F.array_append(a, p)))
    given_board = _known(unicode_trim(F.regexp_replace(F.coalesce(board, F.lit("")), r"(?iu)^(?:pri|priv|privado|processo\s*seletivo.*)$", "")))
    role = lambda b: _named(_named(once, lambda o: F.array_join(rest(b, o), " - ")), lambda r: F.when(r == "", "Geral / Conhecimentos Básicos").otherwise(r))
    whole = _named(given_board, lambda b: F.upper(F.concat(_named(_known(place), lambda p: head(b, p)), role(b))))
    years = _named(year_in(title), lambda y: F.when(y != "", y).otherwise(_named(year_in(F.coalesce(url, F.lit(""))), lambda u: F.when(u != "", u).otherwise(_known(year)))))
    return F.concat(_named(years, given), F.array_join(F.aggregate(_parts(whole), none, kept), " - "))


def number_of(text: Column) -> Column:
    """The number that a text's digits form; null without digits, and where they are too many for an int."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def number_order(text: Column) -> Column:
    """What question numbers are sorted by: 999999 for those without a number, and for 0."""
    return F.coalesce(F.nullif(number_of(text), F.lit(0)), F.lit(999999))


def best_versions(rows: DataFrame, exam: str = "exam_id") -> DataFrame:
    """One question for each (exam, number) from its versions in order of ``seq``.

    rows: (exam, numero_questao, enunciado, opcoes map, resposta, disciplina, images array, seq). A later
    version wins with more options, or with as many and a text that is longer as it came than the kept
    one is without its answer tag. The loser's images go to the winner. Rows without a number or a text
    are left out; of null answers and subjects the defaults stand. Versions of one question are few:
    they are folded in one row.
    """
    none = lambda c: c.isNull() | F.lower(c).isin("none", "")
    bare = lambda c: unicode_trim(F.replace(c, F.lit("\0"), F.lit("")))
    untagged = lambda c: unicode_trim(F.regexp_replace(c, ANSWER_TAG, ""))
    no_images = F.array().cast("array<string>")
    clean = rows.select(
        F.col(exam),
        unicode_trim(F.col("numero_questao")).alias("num"),
        bare(F.col("enunciado")).alias("raw"),
        F.map_entries(F.coalesce("opcoes", F.create_map().cast("map<string,string>"))).alias("opcoes"),
        "resposta",
        "disciplina",
        F.coalesce("images", no_images).alias("images"),
        "seq",
    )
    clean = clean.where(~none(F.col("num")) & ~none(F.col("raw")))
    # versions are folded as they came; tags, texts and JSON are made for the winners alone
    record = F.struct("seq", F.size("opcoes").alias("n"), F.length("raw").alias("length"), "raw", "opcoes", "resposta", "disciplina", "images")
    versions = clean.groupBy(exam, "num").agg(F.sort_array(F.collect_list(record)).alias("v"))
    wins = lambda a, x: (x["n"] > a["n"]) | (x["n"] == a["n"]) & (x["length"] > F.length(untagged(a["raw"])))

    def merged(a: Column, x: Column) -> Column:
        union = lambda first, then: F.when(F.size(then) == 0, first).when(F.size(first) == 0, F.array_distinct(then)).otherwise(F.array_union(first, then))
        return F.when(wins(a, x), x.withField("images", union(x["images"], a["images"]))).otherwise(a.withField("images", union(a["images"], x["images"])))

    one = F.get("v", F.lit(0))
    best = versions.withColumn("b", F.when(F.size("v") == 1, one).otherwise(F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(1))), one, merged)))
    options = F.transform(F.filter("b.opcoes", lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.struct(e["key"], F.replace(e["value"], F.lit("\0"), F.lit("")).alias("value")))
    text = lambda c, default, most: F.left(bare(F.coalesce(F.col(c), F.lit(default))), F.lit(most))
    return best.select(
        exam,
        F.col("num").alias("numero_questao"),
        untagged(F.col("b.raw")).alias("statement"),
        F.when(F.size(options) > 0, F.to_json(F.map_from_entries(options))).alias("options"),
        text("b.resposta", "A", 10).alias("correct_answer"),
        text("b.disciplina", "Geral", 100).alias("subject"),
        F.col("b.images").alias("images"),
        F.col("b.seq").alias("seq"),
        F.size("v").alias("versions"),
    )


def heal(missing: DataFrame, found, keys: list[str], rounds: int = 2) -> DataFrame:
    """What is still missing after up to ``rounds`` extractions; ``found(missing, round)`` returns the rows that one brought."""
    for k in range(rounds):
        missing = missing.join(found(missing, k).select(*keys), keys, "left_anti")
    return missing


def image_places(images: DataFrame, questions: DataFrame, height: float = 1000.0) -> DataFrame:
    """The question of each gap between questions that holds images: (exam, page, gap, x0, y0, x1, y1, index).

    images(exam, page, x0, y0, x1, y1), questions(exam, page, index, x, y). Boxes that recur more than
    twice on a grid of ten are marks of the paper, and boxes with their centre in the outer tenths of
    a page are heads and feet; both go. Gaps run from 20 below one question (or the top margin) to the
    next, and to the bottom margin; one is skipped where the next question is too near. A box is in the
    first gap that it overlaps by more than 10; the boxes of a gap are one, which has to be at
    least 400 large and no thinner than 1 to 10. Its question is the nearest above it in its
    column (200 wide; without any the whole page), else the last one of the columns to the left, else the
    last one of the pages before, else the first one of the page. Below the last question it
    is the last one of the column, or of the pages before. A page before all questions is a cover.
    """
    top, bottom = 0.1 * height, 0.9 * height
    page, corners = ["exam", "page"], ["x0", "y0", "x1", "y1"]
    box, question = F.struct(*corners), F.struct("y", "x", "index")
    recurs = F.count(F.lit(1)).over(W.partitionBy("exam", *(F.bround(F.col(c) / 10) for c in corners)))
    placed = images.withColumn("n", recurs).where((F.col("n") <= 2) & ((F.col("y0") + F.col("y1")) / 2).between(top, bottom))
    kinds = lambda df, *columns: "struct<" + ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"
    rows = placed.select(*page, box.alias("b"), F.lit(None).cast(kinds(questions, "y", "x", "index")).alias("q"))
    rows = rows.unionByName(questions.select(*page, F.lit(None).cast(kinds(images, *corners)).alias("b"), question.alias("q")))
    # a row for each page, with its boxes and its questions from top to bottom
    pages = rows.groupBy(*page).agg(F.collect_set("b").alias("b"), F.sort_array(F.collect_list("q")).alias("q"))
    pages = pages.withColumn("before", F.max(F.array_max(F.transform("q", lambda e: e["index"]))).over(W.partitionBy("exam").orderBy("page").rowsBetween(W.unboundedPreceding, -1)))
    pages = pages.where(F.size("b") > 0)

    def gap(number: Column, over: Column, under: Column, tail: bool) -> Column:
        low = F.coalesce(F.greatest(F.lit(top), over + 20), F.lit(top))
        return F.struct(number.alias("gap"), low.alias("low"), under.cast("double").alias("high"), F.lit(tail).alias("tail"))

    y_of = lambda i: F.get("q", i)["y"]
    inner = F.filter(F.transform("q", lambda e, i: gap(i + 1, y_of(i - 1), e["y"], False)), lambda g: g["high"] > g["low"] + 20)
    pages = pages.withColumn("gaps", F.concat(inner, F.array(gap(F.size("q") + 1, y_of(F.size("q") - 1), F.lit(bottom), True))))
    first = lambda b: F.get(F.filter("gaps", lambda g: (b["y0"] < g["high"] - 10) & (b["y1"] > g["low"] + 10)), F.lit(0))
    met = pages.select(*page, "q", "before", F.explode(F.transform("b", lambda b: F.struct(b.alias("b"), first(b).alias("g")))).alias("m")).where("m.g IS NOT NULL")
    # boxes of one page stand in one row again, so nothing moves: the rows are dealt by page
    ends = [F.min(f"m.b.{c}").alias(c) for c in ("x0", "y0")] + [F.max(f"m.b.{c}").alias(c) for c in ("x1", "y1")]
    joint = met.groupBy(*page, F.col("m.g.gap").alias("gap")).agg(*ends, F.any_value("m.g.tail").alias("tail"), F.any_value("q").alias("q"), F.any_value("before").alias("before"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    joint = joint.where((w * h >= 400) & F.when(h > 0, F.try_divide(w, h)).otherwise(999).between(0.1, 10))

    middle = (F.col("y0") + F.col("y1")) / 2
    nearest = lambda qs: F.array_max(F.transform(qs, lambda e, i: F.struct(e["y"].alias("y"), (-i).alias("i"), e["index"].alias("index"))))["index"]
    of = lambda qs, i: F.get(qs, i)["index"]
    column = F.filter("q", lambda e: F.abs(e["x"] - F.col("x0")) < 200)
    joint = joint.withColumn("c", F.when(F.size(column) > 0, column).otherwise(F.col("q")))
    above = nearest(F.filter("c", lambda e: e["y"] < middle))
    left = nearest(F.filter("q", lambda e: e["x"] < F.col("x0") - 100))
    index = F.when(F.col("tail"), F.coalesce(of(F.col("c"), F.size("c") - 1), "before")).otherwise(F.coalesce(above, left, "before", of(F.col("c"), F.lit(0))))
    return joint.select(*page, "gap", *corners, index.alias("index")).where("index IS NOT NULL")
