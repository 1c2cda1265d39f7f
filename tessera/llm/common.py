"""What several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.  ``bytes.split()``
#: splits at exactly these: x20 and x09 to x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: While a table is written: the shuffles behind it end with it, and a small one becomes a few files, not one for each core (a local disk
#: starts a process for each file, to set its mode); batches that go to Python are bounded in rows and bytes, as texts may be long.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: A table that only this application reads needs no mark of success: on a local disk the driver would start processes to set its mode, and
#: until such a process has loaded its program it counts with all of the driver's memory.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given.

    Only where the session has none and runs in one process (tests), a folder of our own; elsewhere a missing
    setting is an error, as executors would write to disks that others can't read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the JVM may have ended first; the folder's owner cleans up then
            return


@contextmanager
def shuffles_end(spark: SparkSession):
    """Executions in here remove their shuffle files when they end: what they write replaces them."""
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a written table: its lineage ends there, and any executor may read it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_end(spark):
        df.write.options(**NO_MARK).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop(table: DataFrame) -> None:
    """Removes a table that ``stored`` wrote, once nothing lazy reads it any more."""
    discard(table.sparkSession, table._stored_at)


def small(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """Marks a table of a few numbers a row for broadcast if it has at most ``most`` rows (about 30 MB as a hash table)."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def crc_mod(column: str, mod: int):
    """crc32 of an id written as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


_models: list = []


def model(load):
    """Remembers the last two models that ``load`` made in a worker, until the worker lets go of its memories."""
    kept = lru_cache(maxsize=2)(load)
    _models.append(kept)
    return kept


_memos: dict[str, dict] = {}
_former: dict[str, dict] = {}


def memo(owner: str, most: int, keep_former: bool = False) -> dict:
    """A worker's memory of what ``owner`` has worked out for words; emptied at ``most`` entries.

    A Python worker serves one stage after another; when another owner asks, what the
    former ones remembered is let go, so a worker holds one memory at a time.
    ``keep_former``: what was in it when it was last emptied stays within reach of ``former``.
    """
    if any(n != owner for n in _memos):
        forget()
    found = _memos.setdefault(owner, {})
    if len(found) > most:
        if keep_former:
            _former[owner] = found
            found = _memos[owner] = {}
        else:
            found.clear()
    return found


def forget() -> None:
    """Lets go of what this worker remembers for other operators, their models too, and gives freed memory back to the system."""
    if _memos or _former or any(m.cache_info().currsize for m in _models):
        _memos.clear()
        _former.clear()
        for kept in _models:
            kept.cache_clear()
        trim()


def trim() -> None:
    """Gives this worker's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def former(owner: str) -> dict:
    return _former.get(owner, {})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
