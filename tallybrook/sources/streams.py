"""Streaming sources: a Kafka topic, or files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import adapter

# Topic names.
RAW_TOPIC = "events-raw"
ENRICHED_TOPIC = "events-enriched"
ANOMALY_TOPIC = "events-anomalies"
DEAD_LETTER_TOPIC = "events-dead-letter"


def kafka_messages(spark: SparkSession, servers: str, topic: str = RAW_TOPIC,
                   max_per_trigger: int | None = None) -> DataFrame:
    """Messages of a topic from its earliest offset. Needs Spark's Kafka package."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().selectExpr("CAST(key AS STRING) AS key",
                                    "CAST(value AS STRING) AS value")


def publish(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Keyed messages to a topic; equal keys stay in order in one partition."""
    return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def file_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """One message per line of text files."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).selectExpr("CAST(NULL AS STRING) AS key", "value")


def file_events(spark: SparkSession, path: str, max_files: int | None = None,
                ddl: str = adapter.EVENTS_DDL) -> DataFrame:
    """Event rows from parquet files: a folder, or a glob that names files or folders."""
    reader = spark.readStream.schema(ddl)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
