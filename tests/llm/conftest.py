import pytest
from pyspark.sql import functions as F

LONG = "word " * 30000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it all", "de"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from it all", "de"),
    (3, None, None), (4, "", "en"), (5, " \n\t ", "en"), (None, "no id here", "en"),
    (None, None, None), (6, LONG, "fr"), (7, "é😀  tab\t\x00 end", "xx"), (8, "two words", "en"),
    (9, "<|endoftext|> d'été, it's   a b　c", "fr"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeats, and extra columns named as operators' own."""
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")
    return df.select("doc_id", "text", "lang", F.lit("s").alias("source"),
                     F.length("text").cast("bigint").alias("n_chars"), F.lit(1).alias("ids"),
                     F.lit(2).alias("score"), F.lit(3).alias("spans"), F.lit(4).alias("component"),
                     F.lit(5).alias("_text"), F.lit(6).alias("label"), F.lit(7).alias("parts"))


@pytest.fixture
def folder(spark):
    from tallybrook.llm import store
    return store.Folder(spark, "test")
