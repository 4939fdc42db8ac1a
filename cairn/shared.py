"""Tables in the folder that driver and executors share: they cut lineage, and a lost executor costs one stage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, one is made, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"


#: Paths stashed within the innermost workspace.
_STASHED: ContextVar[list[str] | None] = ContextVar("stashed", default=None)


def stash(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write to the shared folder and read again. A workspace deletes it, unless kept."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if not keep and _STASHED.get() is not None:
        _STASHED.get().append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stash(df: DataFrame) -> None:
    """Delete what `stash` wrote; the frame must not be read again."""
    delete(df.sparkSession, df.stash_path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> Iterator[None]:
    """Meanwhile bound the Arrow batches between the JVM and Python by rows and bytes: whole texts are long and several buffers hold each."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def gives_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's function that, at its end, returns to the system what it freed: the worker waits for the next task beside an executor that may need the memory."""

    @wraps(run)
    def task(*args: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was stashed in it. More paths to delete can be appended."""
    paths: list[str] = []
    token = _STASHED.set(paths)
    try:
        yield paths
    finally:
        _STASHED.reset(token)
        for path in paths:
            delete(spark, path)
