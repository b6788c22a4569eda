"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import durable
from graphloom.llm.decontaminate import without_leaks
from graphloom.llm.jaccard_join import jaccard_join
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.piece_codec import Codec, encode
from graphloom.llm.toxicity import fit, without_toxic

#: SQL cannot express the trained stage nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by the model fitted on the labelled rows of the tables in sf_dir."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated three-line passages; n_chars follows the text."""
    out = line_dedup(docs).drop("removed_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id; of rows that repeat an
    id, all stay or go. Rows without an id stay. Documents link at a similarity of 0.8 of their sets of
    five-word shingles."""
    gone = jaccard_join(docs, words=5, percent=80).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document left. Workers have run the other stages too, so they keep fewer segments."""
    return encode(docs, Codec.load(), kept=80_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again. A stage's input and checkpoints
    go once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{durable.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with durable.scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        durable.remove(spark, f"{folder}/{n - 1}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
