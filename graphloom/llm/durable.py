"""Lineage cuts that survive lost executors, and Arrow maps in small batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import StructType

#: The most bytes of rows that go to a Python worker at a time. Texts that are longer go alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[list[DataFrame] | None] = ContextVar("cuts", default=None)


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: spark.checkpoint.dir of the session. Where that is unset, a temporary
    folder if driver and executors are one process; on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run within delete their shuffles from the executors' disks once they end."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder. The shuffles that made it go: the
    written rows are read from then on, by any executor."""
    folder(df.sparkSession)
    with passing(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    scope = _scope.get()
    if scope is not None:
        scope.append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spent(*cuts: DataFrame) -> None:
    """Deletes the files of results of `cut` that nothing will read any more. What was made of them must
    have been cut itself, or written."""
    for df in cuts:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            remove(df.sparkSession, at.get())


@contextmanager
def scratch() -> Iterator[None]:
    """What is cut within is deleted at the end: results that read it must have been written by then."""
    token = _scope.set([])
    try:
        yield
        spent(*_scope.get())
    finally:
        _scope.reset(token)


def one(df: DataFrame) -> Row | None:
    """The first row of a small df, such as a total; its shuffles go."""
    with passing(df.sparkSession):
        return df.select("*").first()


def _bytes(size: str) -> int:
    unit = size.strip().lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(unit[-1:], 0)
    return int(unit.rstrip("kmg")) << scale


def map_arrow(df: DataFrame, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES at most (the session's limit is lowered to that), whose
    worker gives its memory back after each task."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get(_BATCH)) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from over(batches)
        finally:
            settle()

    return df.mapInArrow(run, schema)


def settle() -> None:
    """Returns what a worker no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
