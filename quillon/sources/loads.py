"""A table that is loaded again and again, key by key; each load is published in one step.

A load is a folder with the keys that it was asked to replace and the rows that it has for them. It is
written under another name and renamed when it is whole, so readers see all of it or nothing. Of a key
the last load that was asked for it counts, also where that has no rows; older loads stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table that one task joins or sorts: about 100 MB of its memory.
ROWS_A_TASK = 400_000


def tasks_for(rows: int, most: int = ROWS_A_TASK) -> int:
    return -(-rows // most)


def spread(df: DataFrame, most: int) -> DataFrame:
    """The rows evenly in tasks of so many; for costly columns of small tables, whose one file would be one task."""
    tasks = tasks_for(df.count(), most)
    return df.repartition(tasks) if tasks > 1 else df


def _dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """The rows dealt by key to so many tasks; a few are left to Spark's own choice."""
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the loads that are whole."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("load=")) for n in names if n.startswith("load="))


def replace(rows: DataFrame, asked: DataFrame, path: str, key: str, most: int = ROWS_A_TASK) -> int:
    """Replace what the table has of the keys in ``asked`` by the rows; the load's number.

    Keys without rows are emptied, rows of other keys are left out. When it fails nothing has changed. Of two
    loads at once one fails and can be tried again. The rows are counted first: more of them go to more tasks,
    whatever number of partitions is set.
    """
    spark = rows.sparkSession
    wanted = asked.select(key).distinct()
    at = f"{path}/.{uuid.uuid4().hex}"
    wanted.write.parquet(f"{at}/asked")
    wanted = spark.read.schema(wanted.schema).parquet(f"{at}/asked")
    tasks = tasks_for(rows.count(), most)
    # keys are distinct, so this join repeats no row; a semi-join would be moved below the dealing
    _dealt(rows, key, tasks).join(_dealt(wanted, key, tasks), key).select(*rows.columns).write.parquet(f"{at}/rows")
    number = max(published(spark, path), default=0) + 1
    fs, source = _fs(spark, at)
    target = _fs(spark, f"{path}/load={number}")[1]
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError("another load was published; try again")
    return number


def current(spark: SparkSession, path: str, key: str, most: int = ROWS_A_TASK) -> DataFrame:
    """The table's rows: of each key those of the last load that was asked for it."""
    loads = published(spark, path)
    if not loads:
        raise ValueError("nothing was loaded")
    part = lambda kind: [spark.read.parquet(f"{path}/load={n}/{kind}").withColumn("__load", F.lit(n)) for n in loads]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    asked, rows = union(part("asked")), union(part("rows"))
    tasks = tasks_for(rows.count(), most)  # from the files' footers
    last = _dealt(asked, key, tasks).groupBy(key).agg(F.max("__load").alias("__last"))  # one row a key, so the join repeats none
    # no load is after the last one; = would be taken for a key and deal all rows again
    return _dealt(rows, key, tasks).join(last, key).where("__load >= __last").select(*(c for c in rows.columns if c != "__load"))
