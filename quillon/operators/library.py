"""Search hits, their titles and scores; folders, copies and deletions of exams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the product: stop words of searches, stems of links that are no exams, names of sources.
SEARCH_STOP_WORDS = "prova de para em da do concurso pdf a o e".split()
SKIP_STEMS = "resultado convoca retifica cronograma edital rela resposta recurso divulga homologa inscri isen anexo aditivo comunicado aviso lista decreto lei portaria informa classifica quantitativo local data nota judicial decis cumprimento gabarito preliminar definitiv parecer".split()
SOURCE_LABELS = {"idcap": "IDCAP", "pci": "PCI Concursos", "web": "Web", "qconcursos": "QConcursos", "glm": "GLM IA", "banco": "Banco Interno"}
SOURCE_WORDS = {"idcap": ("idcap", "id cap"), "pci": ("pci", "pciconcurso", "pciconcursos", "pci concursos", "pci concurso")}
BOARD_SOURCES = ("idcap",)
NO_VALUE = ("n/a", "", "null")


def active_sources(query: str, board: str | None, sources: list[str]) -> list[str]:
    """Sources to plan for: one named in the query drops the other named ones, else a named board drops other boards' own."""
    named = next((s for s, words in SOURCE_WORDS.items() if any(w in query.lower() for w in words)), None)
    wanted_board = (board or "").strip().lower()
    if named is not None:
        return [s for s in sources if s == named or s not in SOURCE_WORDS]
    if wanted_board and wanted_board != "n/a":
        return [s for s in sources if s not in BOARD_SOURCES or s in wanted_board]
    return list(sources)


def union_hits(hits: dict[str, DataFrame], order: list[str], caps: dict[str, int]) -> DataFrame:
    """Hits (url, title, score, pos) of the sources in ``order``, each cut to its cap by pos; the first of equal urls stays.

    Hits without a url are left out. Sources that aren't in ``order`` aren't read at all.
    """
    parts = []
    for rank, name in enumerate(order):
        own = hits[name].where(F.col("url").isNotNull() & (F.col("url") != ""))
        own = own.orderBy("pos").limit(caps[name]) if name in caps else own
        parts.append(own.select("url", "title", "score", "pos", F.lit(name).alias("source"), F.lit(rank).alias("rank")))
    every = reduce(DataFrame.unionByName, parts)
    first = F.struct("rank", "pos", "title", "score", "source")
    return every.groupBy("url").agg(F.min(first).alias("f")).select("url", "f.title", "f.score", "f.source")


def target_words(*texts: Column) -> Column:
    """Distinct words of more than two letters of the texts that are no stop words; null and ``n/a`` texts have none."""
    usable = [F.when(F.lower(t).isin(*NO_VALUE), None).otherwise(F.lower(t)) for t in texts]
    words = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.split(F.trim(t), r"\s+") for t in usable)))))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*SEARCH_STOP_WORDS))


def relevance(title: Column, words: Column, role: Column) -> Column:
    """Percent of the words that the title contains; 30 more for the role, up to 100; 50 with neither; never below 10 with words."""
    t, has_role = F.lower(title), role.isNotNull() & ~F.lower(role).isin(*NO_VALUE)
    hits = F.size(F.filter(words, lambda w: F.contains(t, w)))
    base = F.when(F.size(words) > 0, F.floor(hits * 100 / F.size(words))).otherwise(F.lit(0))
    lifted = F.when(has_role & F.contains(t, F.lower(role)), F.least(base + 30, F.lit(100))).when(~has_role & (F.size(words) == 0), 50).otherwise(base)
    return F.when((lifted == 0) & (F.size(words) > 0), 10).otherwise(lifted).cast("bigint")


def skipped(text: Column) -> Column:
    """Does a link's text contain a stem of what is no exam?"""
    return F.exists(F.lit(SKIP_STEMS), lambda s: F.contains(F.lower(text), s))


def source_of(title: Column, url: Column) -> Column:
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    has = lambda *words: reduce(Column.__or__, (F.contains(u, F.lit(w)) for w in words))
    return (
        F.when(F.startswith(t, F.lit("idcap")) | has("idcap", "selecao.net.br"), "idcap")
        .when(F.startswith(t, F.lit("pci")) | has("pciconcursos"), "pci")
        .when(has("qconcursos"), "qconcursos")
        .when(F.startswith(t, F.lit("web -")), "web")
        .when(has("cesgranrio", "cebraspe", "fcc", "vunesp"), "banco")
        .otherwise("web")
    )


def source_label(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCE_LABELS.items() for x in kv)), source), F.lit("Web"))


def folder_name(title: Column, exam: Column) -> Column:
    """The title without its ``Prova - ``, up to the first dot, at most 40 characters; else one with the exam's id."""
    short = F.left(F.substring_index(F.replace(title, F.lit("Prova - "), F.lit("")), ".", 1), F.lit(40))
    return F.when(short != "", short).otherwise(F.concat(F.lit("Pasta Prova "), exam.cast("string")))


#: Ranges that an order is cut into, and rows that the cuts are chosen from.
RANGES, CHOSEN_FROM = 32, 2000


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """The rows with their place from 1 in an order, counted in ranges of it: only one row for each range meets in one task.

    The ranges' bounds are chosen at once, from the keys with the least hashes; which range a row is in then
    follows from the row, so nothing is written. The rows are read once more for the ranges' sizes and
    must be the same then. Rows that ``order`` doesn't tell apart get places of their own, in any order.
    """
    key = F.struct(*order)
    chosen = df.select(*order).orderBy(F.xxhash64(*order)).limit(CHOSEN_FROM).orderBy(*order).collect()
    kinds = [df.schema[c].dataType for c in order]
    at = sorted({i * len(chosen) // RANGES for i in range(1, RANGES)}) if chosen else []
    bounds = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(chosen[i], kinds, order, strict=True))) for i in at]
    place = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    ranged = df.withColumn("__range", place)
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    local = ranged.withColumn("__local", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return local.join(F.broadcast(offsets), "__range").withColumn(column, (F.col("__local") + F.col("__before")).cast("bigint")).drop("__range", "__local", "__before")


def copies(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions that pending exams take over: those of the approved exam of the same source with the least id, where it has any.

    exams(id, source_url, status), questions(id, exam_id, ...); returns the questions' columns with
    ``exam_id`` the taker's and ``copied_from`` the question's id. Null sources match nothing.
    """
    # the least and the next approved exam: a taker can't be one of them, but the rule asks for another exam
    ready = exams.where("status = 'Aprovada' AND source_url IS NOT NULL").groupBy("source_url").agg(F.min("id").alias("from_exam"))
    taking = exams.where("status = 'Pendente'").join(ready, "source_url").select(F.col("id").alias("__taker"), "from_exam")
    taken = taking.join(questions, F.col("from_exam") == F.col("exam_id"))
    return taken.select(*(F.col("__taker").alias(c) if c == "exam_id" else F.col("id").alias("copied_from") if c == "id" else F.col(c) for c in questions.columns))


def delete_exams(folders: DataFrame, exams: DataFrame, children: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders, exams and their children without the doomed exams; a folder goes with its last exam.

    Folders that had no exam before stay, and so do children without an exam.
    """
    gone = doomed.select(F.col("id").alias("__gone")).distinct()
    marked = exams.join(gone, F.col("id") == F.col("__gone"), "left")
    emptied = marked.where("folder_id IS NOT NULL").groupBy(F.col("folder_id").alias("__folder")).agg(F.count("__gone").alias("lost"), F.count(F.lit(1)).alias("had")).where("lost > 0 AND lost = had")
    return folders.join(emptied, F.col("id") == F.col("__folder"), "left_anti"), marked.where("__gone IS NULL").drop("__gone"), children.join(gone, F.col("exam_id") == F.col("__gone"), "left_anti")
