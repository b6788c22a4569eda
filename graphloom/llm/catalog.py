"""Registered queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, fill_middle, host_rules, license_scan, tiff_media, vector_codes
from graphloom.llm import line_dedup as lines
from graphloom.llm.decontaminate import hits
from graphloom.llm.jaccard_join import jaccard_join
from graphloom.llm.passage_dedup import repeated_passages
from graphloom.llm.piece_codec import Codec, encode
from graphloom.llm.token_counts import Vocabulary, token_counts
from graphloom.llm.toxicity import fit, held_out, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    raw = chat_format.raw_lines(turns)
    model = chat_format.fit(raw.withColumn("symbol", chat_format.features(F.col("line"))), turns)
    return chat_format.parse(raw, model)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.features(tiff_media.store(_table(spark, sf_dir, "documents")))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all stored texts, with digests in place of their samples."""
    pages = tiff_media.read_pages(tiff_media.store(_table(spark, sf_dir, "documents")))
    return pages.withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), Codec.load())


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), Vocabulary.load())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"), "segments")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(_table(spark, sf_dir, "documents")).drop("host", "host_rejected")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_middle(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    found = (
        op1_chat_formatting, op2_benchmark_decontamination, op3_substring_dedup, op4_media_columns, media_pages, op5_sentencepiece,
        op6_license_scans, op7_line_dedup, op8_token_counts, op9_toxicity, op10_ngram_jaccard_join, op11_vector_codes,
        op12_host_rules, op13_fill_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_license_scans": license_scan.oracle(), "op7_line_dedup": lines.ORACLE, "op11_vector_codes": vector_codes.ORACLE,
        "op12_host_rules": host_rules.ORACLE, "op13_fill_middle": fill_middle.ORACLE,
    }
