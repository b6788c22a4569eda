"""Graphs and their catalogue as Parquet tables.

A graph lives in <base>/<key>/{nodes,edges,meta}, nodes and edges partitioned by kind so that a query for
one kind reads only that; key is the head of the SHA-256 of its root. The catalogue has one file an entry.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def key_for(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:16]


def save(nodes: DataFrame, edges: DataFrame, base: str, root: str, scanned_at: str) -> str:
    """Writes a graph over what was there for its root; meta comes last and makes it whole."""
    spark, folder = nodes.sparkSession, f"{base}/{key_for(root)}"
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")
    n = spark.read.parquet(f"{folder}/nodes").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols")).first()
    flows = spark.read.parquet(f"{folder}/edges").filter("kind = 'flow'").count()
    row = [(SCHEMA_VERSION, root, scanned_at, n["files"], n["symbols"], flows)]
    spark.createDataFrame(row, "version int, root string, scanned_at string, files long, symbols long, flows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return folder


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    version = spark.read.parquet(f"{folder}/meta").first()["version"]
    if version != SCHEMA_VERSION:
        raise ValueError(f"graph has schema version {version}, not {SCHEMA_VERSION}")
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def catalogue(spark: SparkSession, base: str) -> DataFrame:
    """(root, scanned_at, files, symbols, flows, folder) of all graphs below base, the newest first."""
    return spark.read.parquet(f"{base}/*/meta").withColumn("folder", F.concat_ws("/", F.lit(base), F.substring(F.sha2("root", 256), 1, 16))).orderBy(F.desc("scanned_at"))


def nearest(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, root): for each of paths (path) the deepest root of the catalogue that is it or holds it: its
    prefixes exploded, one equi-join."""
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    return prefixes.join(entries.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
