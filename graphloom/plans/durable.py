"""Lineage cuts of iterative plans, in the session's shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that are sent to every executor.
BROADCAST_ROWS = 400_000
#: The rows that a task sums or sorts, about, where the rows are dealt.
TASK_ROWS, FEW = 200_000, 8
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if driver and executors are one process; on
    a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def _passing(spark: SparkSession) -> Iterator[None]:
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
    """df, computed once and checkpointed in the shared folder. The shuffles that made it go."""
    _folder(df.sparkSession)
    with _passing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a cut, but in compressed columns: for tables with about a row an edge or more."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid4().hex}.parquet"
    with _passing(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, which is a cut, marked to be sent to every executor if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in parts of about TASK_ROWS of so many rows: for sums with nearly a group a row, whose memory a
    task would else hold for as many rows as a split of a file or a joined lot of shuffled parts has. Beyond FEW
    parts there are as many as a shuffle has at least, as a join divides anew what has fewer."""
    parts = rows // TASK_ROWS + 1
    return df.repartition(parts if parts <= FEW else max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
