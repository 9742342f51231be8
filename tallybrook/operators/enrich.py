"""Event enrichment and the event table's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import payload as P, scalars, time as T

PROCESSED_BY = "enrichment-v1"   # fixed value


def enrich(events: DataFrame, processed_at: Column | None = None,
           looked_up: Sequence[str] = ()) -> DataFrame:
    """Server-side keys merged into the payload, and ``processed_at`` set.

    The columns ``looked_up`` (see ``profiles``) move into the payload, as ``_<column>``.
    """
    opened = P.open_object("payload")   # parsed once: equal expressions are shared
    additions = {
        "_enriched": F.lit(True),
        "_category": scalars.category("event_type"),
        "_payloadSize": P.size(opened),
        "_processedBy": F.lit(PROCESSED_BY),
        **{f"_{c}": F.col(c) for c in looked_up},
    }
    now = F.current_timestamp() if processed_at is None else processed_at
    return (events.withColumn("payload", P.merge(opened, additions))
            .withColumn("processed_at", now).drop(*looked_up))


def with_buckets(events: DataFrame) -> DataFrame:
    return (events.withColumn("time_bucket", T.day_bucket("timestamp"))
            .withColumn("hour_bucket", T.hour_bucket("timestamp")))


def rendered(events: DataFrame) -> DataFrame:
    """Adds ``json``: camel-case envelope, ISO-8601 times, nulls left out."""
    body = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("event_type").alias("eventType"),
        F.col("user_id").cast("string").alias("userId"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        P.parse("payload").alias("payload"),
        F.col("source_ip").alias("sourceIp"),
        F.col("processed_at").cast("timestamp").alias("processedAt"),
    )
    fmt = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return events.withColumn("json", F.to_json(body, fmt))


def keyed_messages(events: DataFrame) -> DataFrame:
    """Messages for a keyed stream: key = user, value = envelope JSON."""
    return rendered(events).select(F.col("user_id").cast("string").alias("key"),
                                   F.col("json").alias("value"))
