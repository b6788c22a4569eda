"""Span statistics, logs and progress events, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = 5000
# Severities from the gravest.
LEVELS = ("error", "warn", "info", "debug", "trace")


def span_stats(spans: DataFrame) -> DataFrame:
    """(name, count, total, mean, max, last) of spans (name, ms, seq). In a stream: update or complete mode."""
    return spans.groupBy("name").agg(F.count("*").alias("count"), F.round(F.sum("ms"), 4).alias("total"), F.round(F.avg("ms"), 4).alias("mean"), F.max("ms").alias("max"), F.max_by("ms", "seq").alias("last"))


def log_query(logs: DataFrame, since: int, level: str, text: str, limit: int) -> DataFrame:
    """The newest `limit` logs (seq, level, message) after `since`, at least as grave as `level`, that contain text;
    the oldest of them first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    good = logs.filter((F.col("seq") > since) & (rank <= LEVELS.index(level) + 1) & F.contains(F.lower("message"), F.lit(text.lower())))
    return good.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def ring(logs: DataFrame, size: int = RING) -> DataFrame:
    return logs.orderBy(F.desc("seq")).limit(size)


def frames(events: DataFrame, time: str = "ts", width: str = "1 second") -> DataFrame:
    """(start, frames): how many events each tumbling window has."""
    return events.groupBy(F.window(time, width)["start"].alias("start")).agg(F.count("*").alias("frames"))


def reducer(events: DataFrame) -> DataFrame:
    """(role, target, reads, done, cost, last_path): the state of each agent after its events (role, target, kind,
    cost, path, seq)."""
    return events.groupBy("role", "target").agg(F.count_if(F.col("kind") == "reading").alias("reads"), F.coalesce(F.bool_or(F.col("kind") == "done"), F.lit(False)).alias("done"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"), F.max_by("path", "seq").alias("last_path"))


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a folder as a stream."""
    return spark.readStream.schema(schema).json(folder)
