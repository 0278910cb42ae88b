"""Session helpers: the shared folder and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any URI that Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``, as a URI with its scheme.

    Where it is unset and everything runs in one process (tests) a temporary folder is made, once for
    the session; on a cluster an unset folder is an error, as no other is sure to be shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quillon-shared-")
        _own[spark.sparkContext.applicationId] = at
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    fs, p = hadoop_path(spark, at)
    return fs.makeQualified(p).toString().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            fs, p = hadoop_path(table.sparkSession, file)
            fs.delete(p.getParent(), True)


#: Tables of at most so many bytes, measured, are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row in a hashed table besides its values, about.
ROW_BYTES = 48


def small(table: DataFrame, *columns: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, marked for a broadcast if the columns' values and the rows are few bytes; it is counted for that, so give a written one."""
    values = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(ROW_BYTES))
    size = table.agg(F.sum(values.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(table) if size <= limit else table


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows (one pruned scan)."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)
