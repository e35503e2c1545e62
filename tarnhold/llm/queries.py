"""The registered queries of the training-data operators: thin applications to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, matroska, minhash, mixing, neardup, oracles, packing, pieces, quality, secrets, toolcalls
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.train(docs, quality.trainable(table(spark, sf_dir, "labels"))))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(table(spark, sf_dir, "documents"), width=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(langid.trainable(docs)))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.conversation_links(table(spark, sf_dir, "conversations"))


def op8_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def fingerprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 5: bands of fingerprints joined, and the pairs that share one verified."""
    return minhash.near(table(spark, sf_dir, "documents"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans alone, which SQL can find too."""
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS[:3]], secrets.shown(F.col("found")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_secret_scan, op2_line_quality, op3_near_duplicates, op4_language_id, op5_fingerprints, op6_media_columns,
        op7_tool_calls, op8_piece_segmentation, op9_packed_tokens, op10_source_mixing, fingerprint_links, secret_base_spans,
    )
}

ORACLES: dict[str, str] = oracles.ORACLES
