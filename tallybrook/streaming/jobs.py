"""Streaming jobs.

Counts and tables go through ``foreachBatch`` with batch-id partitions: late events
are always counted, and a repeated batch replaces what it wrote before. Only the
moving baseline keeps operator state. It folds *closed* windows, which a first query
appends to a table and a second one reads, since Spark allows no stateful fold behind
a streaming aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import time as T
from ..functions.bucket import TokenBucket
from ..operators import aggregate, baseline, enrich, ingest, profiles, routing, throttle
from ..sources import tables as stored
from ..sources.tables import Tables
from . import totals

WINDOWS_DDL = "user_id string, window_start timestamp, window_end timestamp, count bigint"
LATENESS = "1 hour"
FLUSH = {"processingTime": "60 seconds"}
CHECK = {"processingTime": "30 seconds"}
ONCE = {"availableNow": True}


# -- events: parse, route, enrich, count, store -------------------------------

def process_events(messages: DataFrame, tables: Tables, checkpoint: str,
                   trigger: dict = FLUSH, minutes: int = 1,
                   user_profiles: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Stream messages into the event, increment and dead-letter tables.

    ``user_profiles`` gives ``user_id`` as text and attributes, which go into the payloads;
    it is asked for each micro-batch, so profiles that changed meanwhile are seen.

    The numbers of read and failed events appear in the query's progress, as
    ``observedMetrics["outcomes"]``; ``totals.TotalsListener`` gathers them.
    """
    parsed = totals.observed(routing.parse_messages(messages), read=F.count(F.lit(1)),
                             failed=F.count_if(F.col("reason").isNotNull()))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = routing.good(batch)
            found, looked_up = events, []
            if user_profiles is not None:
                found = profiles.with_profiles(events, user_profiles())
                looked_up = [c for c in found.columns if c not in events.columns]
            stored.write_events(enrich.enrich(stored.laid_out(found), looked_up=looked_up),
                                tables, batch_id)
            stored.write_increments(aggregate.window_counts(events, minutes=minutes),
                                    tables, batch_id)
            stored.write_dead_letters(routing.dead_letters(batch), tables, batch_id)
        finally:
            batch.unpersist()

    return (parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def live_window_counts(events: DataFrame, lateness: str = LATENESS,
                       minutes: int = 1) -> DataFrame:
    """Window counts with bounded state. Events later than ``lateness`` are dropped."""
    return aggregate.window_counts(_watermarked(events, lateness), minutes=minutes)


def without_repeats(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drops events whose id came before, as far back as the watermark.

    Copies are first dropped within each Arrow batch, so an id with a large share of
    the rows does not fill the one task that keeps its state.
    """
    at = events.columns.index("id")

    def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.sort(np.unique(codes, return_index=True)[1])
            yield batch if len(first) == len(batch) else batch.take(pa.array(first))

    fewer = events.mapInArrow(first_copies, events.schema)
    return _watermarked(fewer, lateness).dropDuplicatesWithinWatermark(["id"])


def _watermarked(events: DataFrame, lateness: str) -> DataFrame:
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", lateness)


# -- anomalies: closed windows, then the moving baseline -----------------------

def close_windows(events: DataFrame, path: str, checkpoint: str, *, size: str = "30 seconds",
                  lateness: str = LATENESS, trigger: dict = CHECK) -> StreamingQuery:
    """Appends each user's window counts to a table once the window is closed."""
    counts = aggregate.user_counts(_watermarked(events, lateness), size).withColumn(
        "user_id", F.col("user_id").cast("string"))
    return (counts.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def baseline_stream(windows: DataFrame, alpha: float = baseline.ALPHA) -> DataFrame:
    """Adds the baseline each closed window meets; a user's state is three numbers.

    Windows arrive in watermark order, so it is enough to sort within a batch. A user
    has one row per window that closed in the batch.
    """
    user = windows.schema["user_id"].dataType.simpleString()

    def fold(key: tuple, chunks: Iterator[pd.DataFrame],
             state: GroupState) -> Iterator[pd.DataFrame]:
        mean, variance, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(chunks)).sort_values("start_us")
        before, after = baseline.ema_run(rows["count"].astype(float).tolist(), mean, variance,
                                         n, alpha)
        state.update(after)
        met = pd.DataFrame(before, columns=["mean", "variance", "observations"],
                           index=rows.index)
        yield pd.concat([rows, met], axis=1)

    folded = (
        windows.select("user_id", T.micros("window_start").alias("start_us"),
                       T.micros("window_end").alias("end_us"), "count")
        .groupBy("user_id")
        .applyInPandasWithState(
            fold,
            f"user_id {user}, start_us bigint, end_us bigint, count bigint, "
            "mean double, variance double, observations bigint",
            "mean double, variance double, observations bigint",
            "append", GroupStateTimeout.NoTimeout)
    )
    return folded.select(
        "user_id", F.timestamp_micros("start_us").alias("window_start"),
        F.timestamp_micros("end_us").alias("window_end"), "count",
        "mean", "variance", "observations")


def detect_anomalies(spark: SparkSession, windows_path: str, tables: Tables, checkpoint: str,
                     *, threshold: float = baseline.THRESHOLD,
                     trigger: dict = CHECK) -> StreamingQuery:
    """Folds the table of closed windows and appends to the anomaly table."""
    windows = spark.readStream.schema(WINDOWS_DDL).parquet(windows_path)
    found = baseline.anomalies(baseline_stream(windows), threshold=threshold)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        stored.write_anomalies(batch, tables, batch_id)

    return (found.writeStream.foreachBatch(store_batch).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


# -- throttle and ingest --------------------------------------------------------

class _States:
    """Bucket states in two slots: batch N reads slot N-1 and replaces slot N."""

    def __init__(self, spark: SparkSession, root: str, bucket: TokenBucket, key: str,
                 at: str, keep: str):
        self.spark, self.slot, self.bucket = spark, f"{root}/states/slot", bucket
        self.key, self.at, self.keep = key, at, keep

    def before(self, batch_id: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.slot}={(batch_id - 1) % 2}") if batch_id else None

    def hand_on(self, decided: DataFrame, before: DataFrame | None, batch_id: int) -> None:
        after = throttle.final_states(decided, key=self.key, at=self.at, bucket=self.bucket)
        if before is not None:
            after = (after.unionByName(before).groupBy(self.key)
                     .agg(F.max("full_at").alias("full_at"), F.max("last_at").alias("last_at")))
        newest = F.timestamp_micros(
            F.floor(after.agg(F.max("last_at")).scalar() / self.bucket.scale))
        limit = T.micros(newest - F.expr(f"INTERVAL {self.keep}")) * self.bucket.scale
        after.where(F.col("full_at") > limit).write.mode("overwrite").parquet(
            f"{self.slot}={batch_id % 2}")


def _cut(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_stream(requests: DataFrame, root: str, checkpoint: str,
                  bucket: TokenBucket = TokenBucket(), *, keep: str = LATENESS,
                  replay: bool = False, trigger: dict = CHECK) -> StreamingQuery:
    """Requests -> calls with outcomes, and keyed messages of the accepted events.

    Per micro-batch: validate, take tokens, stamp, render. A batch of requests must
    arrive in one micro-batch. Calls are in ``<root>/calls``, messages in
    ``<root>/messages``, a folder per micro-batch, replaced if it runs twice.
    """
    states = _States(requests.sparkSession, root, bucket, "api_key", "timestamp", keep)

    def take(batch: DataFrame, batch_id: int) -> None:
        batch, before = batch.persist(StorageLevel.MEMORY_AND_DISK), states.before(batch_id)
        try:
            judged = _cut(ingest.judge(batch, bucket, initial=before),
                          f"{root}/calls/micro_batch={batch_id}")
            events = ingest.accepted_events(batch, judged, replay=replay)
            enrich.keyed_messages(events).write.mode("overwrite").parquet(
                f"{root}/messages/micro_batch={batch_id}")
            states.hand_on(judged.where("allowed IS NOT NULL"), before, batch_id)
        finally:
            batch.unpersist()

    return (requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def throttle_stream(requests: DataFrame, root: str, checkpoint: str,
                    bucket: TokenBucket = TokenBucket(), *, key: str = "api_key",
                    at: str = "timestamp", tie: str = "id", keep: str = LATENESS,
                    trigger: dict = CHECK, **options) -> StreamingQuery:
    """Replays each micro-batch from the states the one before it left.

    A batch uses the batch operator, busy-key splitting included. States lie in two
    slots: batch N reads slot N-1 and replaces slot N, so a repeated batch finds what
    it found the first time. A bucket that has been full for ``keep`` is forgotten; it
    is no different from an unseen one. Decisions are in ``<root>/decisions``.
    """
    states, out = _States(requests.sparkSession, root, bucket, key, at, keep), f"{root}/decisions"

    def decide(batch: DataFrame, batch_id: int) -> None:
        before = states.before(batch_id)
        decided = throttle.replay(batch, bucket, key=key, at=at, tie=tie, initial=before,
                                  **options)
        states.hand_on(_cut(decided, f"{out}/batch_id={batch_id}"), before, batch_id)

    return (requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


# -- retention ------------------------------------------------------------------

def drop_expired(spark: SparkSession, path: str, oldest_kept: str) -> list[str]:
    """Removes the ``time_bucket`` folders of a table before ``oldest_kept``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = set()
    for pattern in ("time_bucket=*", "batch_id=*/time_bucket=*", "fold_id=*/time_bucket=*"):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or ():
            bucket = status.getPath().getName().partition("=")[2]
            if bucket < oldest_kept:
                fs.delete(status.getPath(), True)
                dropped.add(bucket)
    return sorted(dropped)
