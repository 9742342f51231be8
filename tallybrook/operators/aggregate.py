"""Tumbling-window counts and their rollups.

Every count is a partial aggregate before its shuffle, so what moves is one row
per key and map task, however hot the key. Events without a time are in no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import time as T


def _per_window(events: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Counts per key and window. A batch groups by the start alone, which keeps the
    shuffled key narrow; a stream needs the window itself to let go of old state."""
    window = F.window("timestamp", size)
    if events.isStreaming:
        counts = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("count"))
        return counts.select(*keys, F.col("w.start").alias("window_start"),
                             F.col("w.end").alias("window_end"), "count")
    counts = (events.groupBy(window["start"].alias("window_start"), *keys)
              .agg(F.count("*").alias("count")))
    end = F.col("window_start") + F.expr(f"INTERVAL {size}")
    return counts.select(*keys, "window_start", end.alias("window_end"), "count")


def window_counts(events: DataFrame, keys: list[str] | None = None,
                  minutes: int = 1) -> DataFrame:
    """Events per tumbling window and key (user and type by default)."""
    keys = ["user_id", "event_type"] if keys is None else keys
    return (_per_window(events, keys, f"{minutes} minutes")
            .select(*keys, "window_start", "window_end",
                    F.lit(minutes).alias("window_minutes"), "count"))


def user_counts(events: DataFrame, size: str = "30 seconds") -> DataFrame:
    """Events per user and tumbling window: what the anomaly check observes."""
    return _per_window(events, ["user_id"], size)


def _per_bucket(rows: DataFrame, ts: str, unit: str, keys: list[str],
                amount: Column) -> DataFrame:
    """Totals per key and day or hour. Rows are grouped by the bucket's start, a plain
    number; its text is made once per group, not once per row."""
    name = T.day_bucket if unit == "day" else T.hour_bucket
    return (rows.groupBy(*keys, F.window(ts, f"1 {unit}")["start"].alias("_start"))
            .agg(amount.alias("event_count"))
            .select(*keys, name("_start").alias("time_bucket"), "event_count"))


def daily_rollup(increments: DataFrame) -> DataFrame:
    """Window counts, or stored increments, summed into daily counters."""
    return _per_bucket(increments, "window_start", "day", ["user_id", "event_type"],
                       F.sum("count"))


def daily_counts(events: DataFrame) -> DataFrame:
    """The daily counters straight from events, with one shuffle instead of two."""
    return _per_bucket(events, "timestamp", "day", ["user_id", "event_type"], F.count("*"))


def type_counts(events: DataFrame, unit: str = "day") -> DataFrame:
    """Events per type and day or hour, over all users."""
    return _per_bucket(events, "timestamp", unit, ["event_type"], F.count("*"))


def lookup(counters: DataFrame, user_id, event_type: str | None = None,
           first_bucket=None, last_bucket=None) -> DataFrame:
    """Counters of one user, optionally of one type and a range of buckets."""
    found = counters.where(F.col("user_id") == user_id)
    if event_type is not None:
        found = found.where(F.col("event_type") == event_type)
    if first_bucket is not None:
        found = found.where(F.col("time_bucket") >= first_bucket)
    if last_bucket is not None:
        found = found.where(F.col("time_bucket") <= last_bucket)
    return found


def reconcile(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Counters recounted from the raw events beside the stored ones.

    Both sides hold one row per key, so the join key is unique and cannot skew.
    """
    keys = ["user_id", "event_type", "time_bucket"]
    recount = daily_counts(events).withColumnRenamed("event_count", "recounted")
    stored = counters.withColumnRenamed("event_count", "stored")
    zero = F.lit(0).cast("bigint")
    return (recount.join(stored, keys, "full_outer")
            .select(*keys, F.coalesce("recounted", zero).alias("recounted"),
                    F.coalesce("stored", zero).alias("stored"))
            .withColumn("difference", F.col("recounted") - F.col("stored")))
