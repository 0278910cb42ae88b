"""Operators that Spark has no single verb for, composed of its own joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal(keys: list[str], order: list[str]) -> Column:
    """Place of a row in its group, from 0."""
    return (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order (planned as a group limit before the shuffle)."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def asof_latest(df: DataFrame, keys: list[str], time: str, candidates: dict[str, tuple[Column, str]]) -> DataFrame:
    """For each row the latest earlier value of each candidate (condition, column) in its group.

    One window over the union instead of an inequality join: a row sees only rows before it.
    """
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    return reduce(lambda d, c: d.withColumn(c[0], F.last(F.when(c[1][0], F.col(c[1][1])), ignorenulls=True).over(w)), candidates.items(), df)


def streak(days: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """Length of the run of consecutive days that ends at ``as_of`` or the day before; other keys have none."""
    distinct = days.select(key, day).where(F.col(day).isNotNull()).distinct()
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(day)))
    runs = distinct.withColumn("__island", F.date_add(F.col(day), newest)).groupBy(key, "__island").agg(F.max(day).alias("__last"), F.count(F.lit(1)).alias("streak"))
    latest = runs.withColumn("__newest", F.max("__last").over(W.partitionBy(key))).where("__last = __newest")
    return latest.where(F.date_diff(F.lit(as_of).cast("date"), F.col("__last")).isin(0, 1)).select(key, F.col("streak").cast("bigint").alias("streak"))


def sync_actions(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """insert, update or delete for each key of either side; null stored keys are deleted."""
    a, b = stored.select(F.col(key).alias("__s"), F.lit(1).alias("__in_s")), incoming.select(F.col(key).alias("__i"), F.lit(1).alias("__in_i"))
    joined = a.join(b, F.col("__s") == F.col("__i"), "full_outer")
    return joined.select(F.coalesce("__s", "__i").alias(key), F.when(F.col("__in_s").isNull(), "insert").when(F.col("__in_i").isNull(), "delete").otherwise("update").alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str], keep: tuple[str, ...] | None = None) -> DataFrame:
    """Stored rows with the incoming values, and new rows. Keys are unique on each side.

    An incoming null leaves the stored value of the columns in ``keep`` (all of them by default) and
    replaces that of others. Stored rows that nothing comes for stay as they are.
    """
    kept = columns if keep is None else keep
    new = incoming.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in columns))
    value = lambda c: F.coalesce(f"__{c}", c) if c in kept else F.when(F.col("__k").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c))
    return stored.join(new, F.col(key) == F.col("__k"), "full_outer").select(F.coalesce(key, "__k").alias(key), *(value(c).alias(c) for c in columns))


def get_or_create(stored: DataFrame, wanted: DataFrame, key: str, id_column: str) -> DataFrame:
    """Stored rows and one new row, with the next ids, for each wanted key that none has."""
    from quillon.operators.library import numbered

    missing = wanted.select(key).distinct().join(stored, key, "left_anti")
    top = stored.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("__top"))  # one row
    new = numbered(missing, [key], "__n").join(F.broadcast(top))
    return stored.select(id_column, key).unionByName(new.select((F.col("__top") + F.col("__n")).cast(stored.schema[id_column].dataType).alias(id_column), key))


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed parents and their children; null foreign keys stay."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed.select(F.col(key).alias("__k")), F.col(foreign) == F.col("__k"), "left_anti")


#: The reference's stop words for matching questions to text blocks.
MATCH_STOP_WORDS = ("o a os as um uma uns umas de do da dos das em no na nos nas para por com sem que e ou mas se como é são foi nao não".split())


def clean_words(text: str) -> Column:
    """Distinct lower-case words of more than two letters that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*MATCH_STOP_WORDS))


def best_overlap(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text") -> DataFrame:
    """(item, doc, overlap) for each item: the document with which it shares most clean words, the least id on ties.

    A document is eligible with at least 4 shared words, or with 2 that are over 0.6 of its own words.
    Items without an eligible document have a null document and overlap 0. Rows that repeat an item's
    id count together, those that repeat a document's alone; rows with a null id are left out.

    The items are broadcast as one list for each word, so they should be the small side. A document's
    shared words are counted where it is read, so a frequent word sends no rows of its own.
    """
    own = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias(item), text)
    lists = own.select(item, F.explode(clean_words(text)).alias("w")).groupBy("w").agg(F.collect_set(item).alias("__items"))
    read = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias(doc), F.monotonically_increasing_id().alias("__row"), clean_words(text).alias("__words"))
    met = read.select(doc, "__row", F.size("__words").alias("__size"), F.explode("__words").alias("w")).join(F.broadcast(lists), "w")
    hits = met.select(F.explode("__items").alias(item), doc, "__row", "__size").groupBy(item, doc, "__row", "__size").agg(F.count(F.lit(1)).alias("overlap"))
    best = best_per_key(hits.where("overlap >= 4 OR overlap >= 2 AND overlap / __size > 0.6"), [item], [F.desc("overlap"), F.asc(doc)])
    return own.select(item).distinct().join(best, item, "left").select(item, doc, F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))
