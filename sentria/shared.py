"""Working tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_made: list[tuple[object, str]] = []  # (Hadoop configuration, path)
_blocks = threading.local()  # the blocks that a thread is in, each a list of paths


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a session on one machine gets a local folder; on a cluster
    that would be a folder which executors do not see, so it is an error there.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"Set {CHECKPOINT_DIR} to a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="sentria-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes with the block of
    ``passing`` that it is made in, or when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_blocks, "open", None):
        _blocks.open[-1].append(path)
        return path
    if not _made:
        atexit.register(_clear)
    _made.append((spark._jsc.hadoopConfiguration(), path))
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block whose working tables go when it ends: what it makes must be written
    elsewhere by then. For loops, micro-batches and stages."""
    if not hasattr(_blocks, "open"):
        _blocks.open = []
    _blocks.open.append([])
    try:
        yield
    finally:
        for path in _blocks.open.pop():
            delete(spark, path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A block with another value of a session setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    return write_at(df, new_path(df.sparkSession, name), **options)


def write_at(df: DataFrame, path: str, **options) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as ``pyarrow.fs`` reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def uri(spark: SparkSession, path: str) -> str:
    """``qualified``, of any characters: those that a URI can't have are quoted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    quoted = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toASCIIString()
    return re.sub(r"^file:/+", "file:///", quoted)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern names, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(re.sub(r"^file:/+", "file:///", f.getPath().toString()) for f in found or ())


def size_of(spark: SparkSession, path: str) -> int:
    """The bytes of all files below a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _delete(jvm, configuration, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(configuration).delete(where, True)


def _clear() -> None:
    from pyspark import SparkContext

    for configuration, path in _made:
        try:
            _delete(SparkContext._jvm, configuration, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
