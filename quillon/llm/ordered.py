"""Global row numbers of an order, without a task that all rows pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import new_folder

SALT = "__salt"


def in_order(df: DataFrame, order: list[str | Column], number: str, kind: str = "ordered") -> DataFrame:
    """The rows with their places from 0 in ``order``, read from a table of the shared folder.

    Rows are range-partitioned, sorted and written once; a row's number is its place in its file and
    what the files before hold, so it never changes when the table is read again. Rows that ``order``
    doesn't tell apart are dealt at random between neighbouring ranges, so many of them are no hot
    range; each gets a place of its own, in any order. Nulls come first. An empty table stays empty.
    The driver sees one row for each file.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    salted = df.withColumn(SALT, F.rand(1))
    salted.repartitionByRange(*order, SALT).sortWithinPartitions(*order).drop(SALT).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    files = table.groupBy(F.col("_metadata.file_name").alias("__file")).agg(F.count(F.lit(1)).alias("n")).collect()
    files.sort(key=lambda f: int(f["__file"].split("-")[1]))
    starts, at = [], 0
    for f in files:
        starts.append((f["__file"], at))
        at += f["n"]
    offsets = spark.createDataFrame(starts, "__file string, __start long")
    named = table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return named.join(F.broadcast(offsets), "__file").select(*df.columns, (F.col("__start") + F.col("__index")).alias(number))
