"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and returns what it
keeps of ``docs``, with the columns of documents (the last one returns packed pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine scores as junk (op 9). Junk is a
    score under ``fm.THRESHOLD``; without any usable label all documents stay."""
    from . import fm
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fm.reject_low_quality(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component (op 4)."""
    from . import minhash
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts word spans that an earlier document already has (op 5)."""
    from . import substrings
    return substrings.cut_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each found secret by a mask (op 3)."""
    from . import secrets
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences (op 6)."""
    from . import packer
    return packer.pack_documents(docs)
