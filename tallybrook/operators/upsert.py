"""Last-write-wins by key, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import time as T

EVENT_KEY = ["user_id", "time_bucket", "timestamp", "id"]
INSTANT_KEY = ["user_id", "time_bucket", "timestamp"]

# Days that rows are kept.
EVENT_DAYS = 30
ANOMALY_DAYS = 7


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in the order ``by``.

    The rank-1 limit is applied in the map tasks first, so many copies of one key
    leave each task as a single row.
    """
    w = Window.partitionBy(*key).orderBy(*by)
    return (rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))


def upsert_events(events: DataFrame) -> DataFrame:
    """One row per (user, day, time, id): the one processed last."""
    if "time_bucket" not in events.columns:
        events = events.withColumn("time_bucket", T.day_bucket("timestamp"))
    return latest(events, EVENT_KEY,
                  [F.col("processed_at").desc_nulls_last(), F.col("payload")])


def upsert_instants(events: DataFrame) -> DataFrame:
    """One row per (user, day, time): events of the same instant replace each other."""
    if "time_bucket" not in events.columns:
        events = events.withColumn("time_bucket", T.day_bucket("timestamp"))
    return latest(events, INSTANT_KEY,
                  [F.col("processed_at").desc_nulls_last(), F.col("id").desc()])


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; stored tables get their buckets pruned too."""
    cut = now - F.make_dt_interval(days=F.lit(days))
    kept = rows.where(F.col(ts) > cut)
    if "time_bucket" in rows.columns:
        kept = kept.where(F.substring("time_bucket", 1, 10) >= T.day_bucket(cut))
    return kept
