"""Streams of many micro-batches that can be stopped anywhere and started again.

A run lives in a folder: ``state`` is its checkpoint, ``rows/batch=N`` what batch N gave. A batch that runs
again replaces what it wrote, so a run that is stopped and started over the same folder gives the rows
of one that never stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.sinks import own_path

#: Files that a table is landed as, so batches of a run at one file each.
FILES = 4


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def land(df: DataFrame, order: list[str], files: int = FILES, at: str | None = None) -> str:
    """Write the rows as files in an order and return their folder.

    File streams take files by their times, so the files' times are set in the same order. More rows may
    be landed in a folder later: their files come after those that are there.
    """
    spark, at = df.sparkSession, at or own_path(df.sparkSession, "landed")
    fs, p = _folder(spark, at)
    there = {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(p)} if fs.exists(p) else {}
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("append").parquet(at)
    new = sorted((f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-") and f.getPath().getName() not in there), key=lambda f: f.getName())
    first = max([1_700_000_000_000, *there.values()]) + 1000
    for i, file in enumerate(new):
        fs.setTimes(file, first + 1000 * i, -1)
    return at


def landed(spark: SparkSession, at: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A folder of ``land`` as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "part-*").parquet(at)


def run(stream: DataFrame, at: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run over all files that are there, and return the rows of all batches so far with their ``batch``.

    ``each`` makes of a batch's rows and number what is written for it. What it reads must be what earlier
    batches wrote, so that it gives the same when it runs again.
    """
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        if each is None:
            rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")
            return
        # ``each`` may read the rows more than once, and state is kept once a batch
        rows.write.mode("overwrite").parquet(f"{at}/given")
        given = spark.read.schema(rows.schema).parquet(f"{at}/given")
        each(given, batch).write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return batches(spark, at) if exists(spark, f"{at}/rows") else spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))


def batches(spark: SparkSession, at: str, before: int | None = None) -> DataFrame | None:
    """What the batches of a run wrote, or those before one; None where there are none."""
    if not exists(spark, f"{at}/rows"):
        return None
    rows = spark.read.parquet(f"{at}/rows")
    return rows if before is None else rows.where(F.col("batch") < before)
