"""Cleans the documents table in stages; each is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybrook.llm import stages, store

STAGES = stages.STAGES

# A trained classifier and a tokenizer are part of it: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.Folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = folder.cut(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
