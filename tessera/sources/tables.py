"""Reading and writing of intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A partition that is worth a task of its own has at least so many bytes.
LEAST_BYTES = 256 << 10
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer partitions than there are cores and bytes to share out.

    A small table is often one row group, so one task; a large one has partitions enough and stays as it is.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session in one process may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own or not os.path.isdir(_own[app].removeprefix("file://")):
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first; the folder's owner cleans up then
            return


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def few_at_a_time(spark: SparkSession, rows: int):
    """What is executed in here sends at most so many rows to Python at a time: for tables whose rows have megabytes each."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` as a written table: computed once, and any executor may read it.

    The shuffle files behind it are removed as soon as it is written.  ``group_bytes``: for rows of megabytes; a writer
    holds about so much, looking after each row (it would not look before the hundredth), and a reader as much.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
