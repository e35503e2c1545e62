"""A pipeline over ``documents``: language, near copies, secrets, mix, pieces.

Each stage takes what the one before kept; between two stages the rows are a Parquet table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnhold.llm import langid, mixing, neardup, pieces, secrets
from tarnhold.llm.common import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the trained classifier rejects go."""
    return langid.accepted(docs, langid.train(langid.trainable(docs)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return neardup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secrets.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source come to its target: documents are repeated, cut or left out as the mix takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, its N best segmentations and whether they decode to it."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", known_language),
    ("near duplicates", without_near_copies),
    ("secret scan", without_secrets),
    ("source mixing", mixed_sources),
    ("piece encoding", encoded),
]

#: Trained models, MinHash and the piece lattice have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/tarnhold/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
