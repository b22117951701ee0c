"""Frames that are computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a frame that is broadcast (some 100 bytes each in Spark's hash tables).
BROADCAST_ROWS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: the session's ``spark.checkpoint.dir``, or a local one where none is set and the master is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: read again where it is used again, also after executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def known(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once and counted, to be broadcast in joins if it has up to ``most`` rows: then what it meets isn't shuffled."""
    df = once(df)
    return F.broadcast(df) if df.count() <= most else df


#: Rows of a task whose number must not grow with the input.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by ``by`` in tasks of about ``TASK_ROWS`` rows: what sorts or groups them takes as much memory at any size."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *by)


def written(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written ``path`` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def finished(spark: SparkSession, folder: str) -> list[str]:
    """Folders directly under ``folder`` that Spark has written to their ends."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` to a new folder beside ``path``, which takes its place when all is written: readers see the old or the new whole."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write(new)
    old_, new_ = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    files = old_.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old_, True)
    if not files.rename(new_, old_):
        raise OSError(f"{new} could not be renamed to {path}")
