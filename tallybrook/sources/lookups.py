"""Point lookups on the stored tables: few buckets opened, few row groups read.

A time range becomes a range of bucket folders, so files outside it are never listed. In
the files rows lie by user and newest first; the range and the Bloom filter of a row group
tell whether it holds a user at all. Newest-first lookups with a limit open the newest
bucket first and older ones only while rows are missing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import time as T
from ..operators import aggregate, toplists
from .tables import Tables


def newest(spark: SparkSession, tables: Tables) -> dt.datetime | None:
    """The newest stored event time, from the newest bucket alone."""
    days = newest_buckets(spark, tables.events)
    if not days:
        return None
    return tables.read_stored(spark).where(F.col("time_bucket") == days[0]).agg(
        F.max("timestamp").cast("timestamp_ntz")).first()[0]


def newest_buckets(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's buckets, newest first, from its folders: a table keeps a month."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        jvm.Path(root, "batch_id=*/time_bucket=*")) or ()
    return sorted({status.getPath().getName().partition("=")[2] for status in found}, reverse=True)


def days_between(start: dt.datetime, end: dt.datetime) -> list[str]:
    """Day buckets of a range, newest first."""
    days = (end.date() - start.date()).days
    return [(end.date() - dt.timedelta(days=i)).isoformat() for i in range(days + 1)]


def until_enough(rows: DataFrame, buckets: list[str], limit: int) -> list[str]:
    """The first of ``buckets``, newest first, that together hold ``limit`` rows, or all.

    One bucket is counted, then two, then four more, so there are few jobs, and of the
    older buckets no more are opened than lie newer ones before them.
    """
    taken, width, missing = [], 1, limit
    while buckets and missing > 0:
        part, buckets = buckets[:width], buckets[width:]
        missing -= rows.where(F.col("time_bucket").isin(part)).count()
        taken, width = taken + part, 2 * width
    return taken


def user_events(spark: SparkSession, tables: Tables, user_id: str, end: dt.datetime, *, hours: int | None = None,
                limit: int | None = None, event_type: str | None = None) -> DataFrame:
    """Newest stored events of a user, ties in id order, each in its last written state.

    The same rows as ``toplists.user_events`` gives on all events up to ``end`` (UTC). No
    time range but its buckets is opened, and no bucket once the limit is reached.
    """
    start = end - dt.timedelta(hours=T.clamp(hours, *toplists.EVENT_HOURS))
    limit = T.clamp(limit, *toplists.EVENT_LIMIT)
    found = tables.read_events(spark).where(
        (F.col("user_id") == user_id) & F.col("timestamp").between(_utc(start), _utc(end)))
    if event_type is not None:
        found = found.where(F.col("event_type") == event_type)
    days = until_enough(found, days_between(start, end), limit)
    return (found.where(F.col("time_bucket").isin(days))
            .orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit))


def _utc(at: dt.datetime):
    return F.to_timestamp(F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f") + "+00:00"))


def counter(spark: SparkSession, tables: Tables, user_id: str, event_type: str | None = None,
            first_bucket: str | None = None, last_bucket: str | None = None) -> DataFrame:
    """Daily counters of a user: the sum of the increments in the buckets asked for."""
    return (aggregate.lookup(tables.read_counts(spark), user_id, event_type, first_bucket, last_bucket)
            .groupBy("user_id", "event_type", "time_bucket").agg(F.sum("count").alias("event_count")))


def recent_anomalies(spark: SparkSession, tables: Tables, now: dt.datetime, *, hours: int | None = None,
                     limit: int | None = None) -> DataFrame:
    """Newest stored anomalies of each of the last hour buckets; no other is opened."""
    return toplists.recent_anomalies(tables.read_anomalies(spark), _utc(now), hours=hours, limit=limit)


def user_hour_anomalies(spark: SparkSession, tables: Tables, user_id: str, hour: str) -> DataFrame:
    """Stored anomalies of a user in one hour bucket, newest first."""
    return toplists.user_anomalies(tables.read_anomalies(spark), user_id, hour)


def disorder(stored: DataFrame) -> DataFrame:
    """Per bucket, its rows and those that do not follow the one before them in their file.

    The order is that of the table: users together, newest first, ties in id order. Each
    row meets the one before it by its place in the file, so no file is sorted again.
    """
    place = stored.select("time_bucket", "user_id", "timestamp", "id", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.row_index").alias("at"))
    before = place.select("file", (F.col("at") + 1).alias("at"), F.col("user_id").alias("_u"),
                          F.col("timestamp").alias("_t"), F.col("id").alias("_i"))
    later = (F.col("user_id") < F.col("_u")) | (
        (F.col("user_id") == F.col("_u")) & ((F.col("timestamp") > F.col("_t")) | (
            (F.col("timestamp") == F.col("_t")) & (F.col("id") < F.col("_i")))))
    return (place.join(before, ["file", "at"], "left").groupBy("time_bucket")
            .agg(F.count("*").alias("n"), F.count_if(F.coalesce(later, F.lit(False))).alias("out_of_order")))
