"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.durable import cut, one, spent

#: Links that a task works on at least; fewer tasks leave fewer small shuffle files.
TASK_LINKS = 100_000


def _either(rows: DataFrame, *links: Column) -> DataFrame:
    """All of the links of each row, in one pass over rows."""
    return rows.select(F.inline(F.array(*links)))


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """Relinks every neighbour of a vertex to the smallest of the neighbourhood.

    upward: the neighbours larger than the vertex (large star); else the vertex and its smaller ones.
    """
    both = _either(edges, F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if upward:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = _either(joined, F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of edges (a, b), where component is the smallest id reachable.

    Ids are longs; self links and repeated links are ignored, rows with nulls too. Each round is two
    aggregations with joins, its result is cut, and the number of rounds grows with the logarithm of
    the longest path. Nothing but two numbers a round reaches the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    for _ in range(rounds):
        before, seen, mark = now, mark, tuple(one(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))))
        if mark == seen:
            break
        tasks = mark[0] // TASK_LINKS + 1
        now = cut(_stars(_stars(now.coalesce(tasks), True).coalesce(tasks), False).coalesce(tasks))
        spent(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
