"""Files written by tasks into a shared folder, made visible by one commit.

A task streams a file under a name that nobody else uses and returns that name as a row. The rows of
the job's successful attempts become a table; from it the files are renamed by tasks and the manifest
is written, as a table too, so the driver holds no row for a file. What lost or repeated attempts have
left keeps its temporary name and is deleted. A folder without a finished manifest holds nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import hadoop_path, written

TASK_SCHEMA = "shard long, part long, temporary string, bytes long, records long, units long"
MANIFEST = "_manifest"
#: Shards whose files one task numbers.
_NUMBERED_TOGETHER = 4096


def _local(folder: str) -> str | None:
    """The path of a ``file:`` folder; None where it is in another store."""
    scheme, colon, rest = folder.partition(":")
    return "/" + rest.lstrip("/") if colon and scheme == "file" else None


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Sink:
    """From a task: a new file with a temporary name. Keep ``name`` only after ``close``."""

    def __init__(self, folder: str):
        self.name, self.bytes = f"_tmp-{uuid.uuid4().hex}", 0
        local = _local(folder)
        if local is not None:
            os.makedirs(local, exist_ok=True)
            self._file = open(f"{local}/{self.name}", "wb", buffering=1 << 20)  # noqa: SIM115
        else:
            store, path = _store(folder)
            store.create_dir(path, recursive=True)
            self._file = store.open_output_stream(f"{path}/{self.name}")

    def write(self, data: bytes | memoryview) -> None:
        self._file.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if hasattr(self._file, "fileno") and hasattr(self._file, "raw"):
            self._file.flush()
            os.fsync(self._file.fileno())
        self._file.close()


def source(folder: str, name: str) -> BinaryIO:
    """From a task: a file that can be read from any place."""
    local = _local(folder)
    if local is not None:
        return open(f"{local}/{name}", "rb")  # noqa: SIM115
    store, path = _store(folder)
    return store.open_input_file(f"{path}/{name}")


def task_row(*values) -> pa.RecordBatch:
    """A row of ``TASK_SCHEMA``."""
    names = [f.partition(" ")[0] for f in TASK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)


def _rename(folder: str, old: str, new: str) -> None:
    """Done again, by a second attempt of the task, it changes nothing."""
    local = _local(folder)
    if local is not None:
        if os.path.exists(f"{local}/{old}"):
            os.replace(f"{local}/{old}", f"{local}/{new}")
        elif not os.path.exists(f"{local}/{new}"):
            raise OSError(f"{old} in {folder} is gone")
        return
    from pyarrow import fs

    store, path = _store(folder)
    if store.get_file_info(f"{path}/{old}").type != fs.FileType.NotFound:
        store.move(f"{path}/{old}", f"{path}/{new}")
    elif store.get_file_info(f"{path}/{new}").type == fs.FileType.NotFound:
        raise OSError(f"{old} in {folder} is gone")


def commit(spark: SparkSession, folder: str, tasks: DataFrame, extension: str) -> DataFrame:
    """Run the writing job, rename its files in (shard, part) order, write the manifest.

    The manifest has name, bytes, records, units and units_before (of all files before) for each file.
    ``folder`` has to be a URI with a scheme.
    """
    fs, root = hadoop_path(spark, folder)
    fs.mkdirs(root)
    found = written(tasks, "files").withColumn("run", F.floor(F.col("shard") / _NUMBERED_TOGETHER))
    runs = found.groupBy("run").agg(F.sum("units").alias("n"))
    # one row for each 4096 shards meets in one task
    earlier = runs.select(F.col("run").alias("r"), F.coalesce(F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("units").over(W.partitionBy("run").orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = found.withColumn("inside", inside).join(earlier, F.col("run") == F.col("r"))
    name = F.format_string(f"shard-%06d-%05d.{extension}", "shard", "part")
    named = named.select("temporary", name.alias("name"), "bytes", "records", "units", (F.col("earlier") + F.col("inside")).cast("long").alias("units_before"))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _rename(folder, old, new)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])

    schema = named.drop("temporary").schema
    named.mapInArrow(rename, schema).write.parquet(f"{folder}/{MANIFEST}")
    for left in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "_tmp-*")) or []:
        fs.delete(left.getPath(), False)
    return spark.read.schema(schema).parquet(f"{folder}/{MANIFEST}")


def each_file(manifest: DataFrame, together: int = 64 << 20) -> DataFrame:
    """The manifest dealt out for reading, about ``together`` bytes to a task."""
    total = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    parts = min(total["n"], max(-(-(total["b"] or 0) // together), min(total["n"], 2 * manifest.sparkSession.sparkContext.defaultParallelism)))
    return manifest.repartition(max(1, parts))
