"""The stages of the document pipeline, each by one operator of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bpe, decontam, ngram_join, secret_scan, store, toxicity

REJECT_TOXIC = 0.7
SHINGLE, SIMILARITY = 5, (80, 100)


def training_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)`` of the rows a model may learn from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    return labels.where(fold != 1).select("doc_id", F.col("toxic").alias("label"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.7 or more."""
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, toxicity.fit(docs, labels), REJECT_TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of similar texts.

    Of repeated rows with one id and words one stays. Documents without words, or without
    an id, belong to no group and stay.
    """
    folder = store.Folder(spark, "near-copies")
    found = ngram_join.components(docs, folder, SHINGLE, SIMILARITY)
    # written, so that Spark knows their size when it plans the joins with the texts
    gone = folder.cut(found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct(), "gone")
    several = folder.cut(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count()
                         .where("count > 1").select("doc_id"), "several")
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col("doc_id").isNotNull()
    place = "_place_in_group"
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = rest.join(several, "doc_id", "left_semi").select(*docs.columns)
    one = repeated.where(worded).withColumn(place, at).where(F.col(place) == 1).drop(place)
    return (rest.join(several, "doc_id", "left_anti").select(*docs.columns)
            .unionByName(one).unionByName(repeated.where(~worded)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts."""
    return secret_scan.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text back."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(docs, path, pattern, keep=("doc_id", "lang", "source"), check=True)
    return tokens.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", to_tokens),
]
