"""Corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns rows; they are written as Parquet and reread as the
next stage's documents. All but the last return the columns of ``documents``. Nulls, empty tables,
repeated rows and extra columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.op2_quality import judge
from quillon.llm.op4_packing import pack_documents
from quillon.llm.op5_suffix_dedup import remove_repeats
from quillon.llm.op9_decontaminate import find_hits
from quillon.llm.op10_ngram_join import near_duplicates
from quillon.llm.shared import removed, small, written


def _plain(docs: DataFrame) -> DataFrame:
    """Other columns under names that no operator makes."""
    return docs.select(*(F.col(c) if c in ("doc_id", "text") else F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)))


def _named(out: DataFrame, columns: list[str], changed: dict | None = None) -> DataFrame:
    """Back to the names of the documents' columns."""
    own = lambda i, c: F.col(c if c in ("doc_id", "text") else f"c_{i}")
    return out.select(*((changed or {}).get(c, own(i, c)).alias(c) for i, c in enumerate(columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _named(judge(_plain(docs)).where("kept"), docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates.

    Of rows that repeat an id and a text one stays; an id with several texts goes if all of them do;
    documents without an id all stay. Only ids to drop are joined, so texts move only where these are
    too many to broadcast.
    """
    found = written(near_duplicates(docs), "classes")
    gone = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias("gone")).where("gone").select("doc_id")
    out = docs.join(small(gone, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id IS NULL")) if repeated else out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents with nothing else go."""
    cut = remove_repeats(_plain(docs))
    text, touched = F.col("kept_text"), F.size("removed_spans") > 0
    left = cut.where(~(touched & ~text.rlike(r"[^\x20\x09-\x0D]")))
    return _named(left, docs.columns, {"text": text} | ({"n_chars": F.when(touched, F.length(text).cast("long")).otherwise(F.col(f"c_{docs.columns.index('n_chars')}"))} if "n_chars" in docs.columns else {}))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    hits = find_hits(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _named(hits.where(F.size("hit_places") == 0), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if at:
            removed(before)
    return docs


#: SQL can't tokenise; tests/llm/test_pipeline.py holds the stages and run() against a brute-force version.
ORACLE_SQL = None
