"""Corpus pipeline over ``documents``: each stage applies one operator of ``tidewater.llm`` to
all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import stages
from tidewater.session import scratch_path

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.packing),
]

# Trained scores, near-duplicate components and tokenizer ids are beyond SQL; the tests hold each
# stage against its operator, and the operators against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
