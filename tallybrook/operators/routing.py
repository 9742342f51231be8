"""Parsing of stream messages and routing of the bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import payload as P

ENVELOPE = ("id string, eventType string, userId string, timestamp string, "
            "payload string, sourceIp string, processedAt timestamp, _corrupt string")


def event_time(text: Column) -> Column:
    """An instant from ISO text or from whole or decimal epoch seconds; null if neither."""
    seconds = F.timestamp_micros((text.try_cast("decimal(20,6)") * 1000000).cast("bigint"))
    return F.when(text.rlike(r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"), seconds).otherwise(text.try_cast("timestamp"))


def parse_messages(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message JSON -> event columns, the ``raw`` text and a failure ``reason``.

    ``reason`` is null for a good event. Fields outside the envelope are dropped, other
    columns of the messages too unless named in ``keep``.
    """
    opened = messages.select(
        *keep,
        F.col("value").cast("string").alias("raw"),
        F.from_json(F.col("value").cast("string"), ENVELOPE,
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        .alias("e"),
    )
    time = event_time(F.col("e.timestamp"))
    unread = F.col("e.timestamp").isNotNull() & time.isNull()
    return opened.select(
        *keep,
        "raw",
        F.col("e.id").alias("id"),
        F.col("e.eventType").alias("event_type"),
        F.col("e.userId").alias("user_id"),
        time.alias("timestamp"),
        F.col("e.payload").alias("payload"),
        F.col("e.sourceIp").alias("source_ip"),
        F.col("e.processedAt").alias("processed_at"),
        (F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull() | unread, "malformed_json")
          .when(F.col("e.payload").isNull(), "null_payload")
          .when(~P.is_object("e.payload"), "payload_not_object")
          .when(F.col("e.eventType").isNull(), "null_event_type")
          .when(F.col("e.timestamp").isNull(), "null_timestamp")
          .when(F.col("e.userId").isNull(), "null_user_id")
          .when(F.col("e.id").isNull(), "null_id")).alias("reason"),
    )


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("raw", "reason")


def dead_letters(parsed: DataFrame, failed_at=None) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select(
        "raw", "reason",
        (F.current_timestamp() if failed_at is None else failed_at).alias("failed_at"))


def replay_dead_letters(letters: DataFrame, repair=None) -> DataFrame:
    """Dead letters parsed again, optionally after a ``repair`` of ``value``."""
    messages = letters.select(F.col("raw").alias("value"))
    return parse_messages(messages.transform(repair) if repair else messages)
