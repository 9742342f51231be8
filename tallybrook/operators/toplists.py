"""Newest-first lookups: a user's events, recent anomalies.

``row_number() <= n`` plans as a window group limit, which keeps n rows per group in
each map task before the shuffle. One user holding a third of the events therefore
sends n rows per task, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import time as T

# Defaults and bounds of the query parameters.
EVENT_HOURS = (1, 168, 24)
EVENT_LIMIT = (1, 1000, 100)
ANOMALY_HOURS = (1, 24, 1)
ANOMALY_LIMIT = (1, 200, 50)


def newest(df: DataFrame, ts: str = "timestamp") -> Column:
    """The latest time in ``df``, as a scalar subquery: the 'now' of a replay."""
    return df.agg(F.max(ts)).scalar()


def between(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Time range, both ends included. Stored tables also get their day buckets pruned."""
    found = events.where(F.col("timestamp").between(start, end))
    if "time_bucket" in events.columns:
        found = found.where(F.col("time_bucket").between(T.day_bucket(start),
                                                         T.day_bucket(end)))
    return found


def look_back(events: DataFrame, end: Column, hours: int | None = None) -> DataFrame:
    """The last ``hours`` up to ``end``, within the allowed range of hours."""
    return between(events, T.hours_before(end, T.clamp(hours, *EVENT_HOURS)), end)


def day_buckets(events: DataFrame, user_id, days: list[str]) -> DataFrame:
    """All events of a user in the given day buckets: one pruned scan for their union."""
    return events.where((F.col("user_id") == user_id) & F.col("time_bucket").isin(days))


def user_events(events: DataFrame, user_id, end: Column, *, hours: int | None = None,
                limit: int | None = None, event_type: str | None = None) -> DataFrame:
    """Newest events of one user; ties in id order."""
    found = look_back(events.where(F.col("user_id") == user_id), end, hours)
    if event_type is not None:
        found = found.where(F.col("event_type") == event_type)
    return (found.orderBy(F.col("timestamp").desc(), F.col("id"))
            .limit(T.clamp(limit, *EVENT_LIMIT)))


def events_per_user(events: DataFrame, end: Column, *, hours: int | None = None,
                    limit: int | None = None) -> DataFrame:
    """Newest events of every user, numbered by ``rank``."""
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("id"))
    return (look_back(events, end, hours).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= T.clamp(limit, *EVENT_LIMIT)))


def recent_anomalies(anomalies: DataFrame, now: Column, *, hours: int | None = None,
                     limit: int | None = None) -> DataFrame:
    """Newest anomalies of each of the last hour buckets; the limit is per bucket."""
    back = T.clamp(hours, *ANOMALY_HOURS) - 1
    w = (Window.partitionBy("time_bucket")
         .orderBy(F.col("detected_at").desc(), F.col("anomaly_id")))
    return (
        anomalies
        .where(F.col("time_bucket").between(T.hour_bucket(T.hours_before(now, back)),
                                            T.hour_bucket(now)))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= T.clamp(limit, *ANOMALY_LIMIT))
        .orderBy(F.col("time_bucket").desc(), F.col("detected_at").desc(), "anomaly_id")
        .select("user_id", "metric", "observed_value", "expected_value", "z_score",
                "detected_at", "severity")
    )


def user_anomalies(anomalies: DataFrame, user_id, hour: str) -> DataFrame:
    """Anomalies of one user and hour bucket, newest first."""
    return (anomalies.where((F.col("user_id") == user_id) & (F.col("time_bucket") == hour))
            .orderBy(F.col("detected_at").desc(), "anomaly_id"))
