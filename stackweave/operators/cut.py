"""Tables that outlive lost executors, in the folder that all machines of the cluster share; lineage ends at them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_state = threading.local()


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one, if all runs on this machine; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        made = context._jsc.sc().getCheckpointDir()
        if made.isDefined():
            folder = made.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="spark-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; within temporary(), it is deleted at the end."""
    path = f"{shared(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if getattr(_state, "open", None):
        _state.open[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again after a loss."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written and read again."""
    return written(df, "cut")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of place() that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end, also after an error, what place() and written() make within.

    Yields keep(df, what), which writes a result that stays (until the end of a temporary() around this one).
    """
    stack = _state.__dict__.setdefault("open", [])
    made: list[str] = []
    stack.append(made)

    def keep(df: DataFrame, what: str) -> DataFrame:
        at = stack.index(made)
        out = written(df, what)
        path = stack[-1].pop()
        if at:
            stack[at - 1].append(path)
        return out

    try:
        yield keep
    finally:
        stack.remove(made)
        for path in made:
            discard(spark, path)
