"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where each intermediate table lies that is still there.
_written: set[str] = set()
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Bytes of a row group, which a task holds until it is written.
GROUP_BYTES = 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are removed as soon as it ends: the written table stands for them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp("-sparktab")


def temporary(spark: SparkSession) -> str:
    """A new folder among the intermediate tables, removed with them."""
    path = f"{_folder(spark)}/sparktab-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a temporary folder is
    taken on a single machine, and on a cluster that is an error.  The table outlives lost executors and
    cuts the lineage; it is removed by ``drop`` or ``release``, at the latest when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/sparktab-{uuid.uuid4().hex}"
    with _shuffles_let_go(spark):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` gave back and that nothing reads any more."""
    for table in tables:
        if (path := _path_of.pop(table, None)) in _written:
            _remove(table.sparkSession, path)


def release() -> None:
    """Remove every table that ``durable`` wrote; results that still read one must be written before."""
    spark = SparkSession.getActiveSession()
    while _written and spark is not None:
        _remove(spark, next(iter(_written)))


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before; what remains is in the cluster's own checkpoint folder
        _written.clear()
