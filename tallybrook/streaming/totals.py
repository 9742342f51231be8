"""Running totals of streams: counts observed in each micro-batch, gathered into a table.

Streams count in passing (``observed``), so no row is read a second time. A listener turns
each micro-batch's counts into rows of a table; totals and rates are queries on it.
"""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import (
    QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener)

from ..operators import metrics

TOTALS_DDL = ("query_id string, query_name string, batch_id bigint, at timestamp, "
              "metric string, value bigint")
OBSERVATION = "outcomes"


def observed(stream: DataFrame, **counts: Column) -> DataFrame:
    """The stream, whose progress tells ``counts`` of each micro-batch. One observation a query.

    Every time a ``foreachBatch`` function reads its batch counts, so one that reads it more
    than once must persist it first. Rows that Spark computes anew, after an executor was
    lost, may count again; totals that must be exact then come from the stored tables.
    """
    return stream.observe(OBSERVATION, *[column.alias(name) for name, column in counts.items()])


class TotalsListener(StreamingQueryListener):
    """Appends the counts of every finished micro-batch of a session's streams to a table.

    A micro-batch gives one row per count. One that was reported twice counts once for the
    readers below. Queries keep their id over restarts from a checkpoint. A report is lost
    if the driver ends between a micro-batch's commit and its report; ``gaps`` names those.
    Queries without observed counts leave no rows. A table that cannot be written stops no
    stream: the rows are kept and go with the next report.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._held: list[tuple] = []
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(OBSERVATION)
        if counts is None:
            return
        at = datetime.fromisoformat(progress.timestamp)
        self._held += [(str(progress.id), progress.name, progress.batchId, at, metric, value)
                       for metric, value in counts.asDict().items() if value is not None]
        self._write()

    def _write(self) -> None:
        if not self._held:
            return
        rows = self.spark.createDataFrame(self._held, TOTALS_DDL)
        rows.coalesce(1).write.mode("append").parquet(self.path)
        self._held.clear()

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        try:
            self._write()
        finally:
            with self._news:
                self._ended.add(str(event.runId))
                self._news.notify_all()

    def finished(self, query: StreamingQuery, timeout: float = 60.0) -> bool:
        """Waits for the query's end, then until its last report has been taken in."""
        query.awaitTermination()
        with self._news:
            return self._news.wait_for(lambda: str(query.runId) in self._ended, timeout)


def per_batch(spark: SparkSession, path: str) -> DataFrame:
    """The gathered rows, each query's micro-batch and metric once."""
    return spark.read.schema(TOTALS_DDL).parquet(path).dropDuplicates(["query_id", "batch_id", "metric"])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, total, batches)`` over all streams."""
    return per_batch(spark, path).groupBy("metric").agg(
        F.sum("value").alias("total"), F.count("*").alias("batches"))


def dashboard(spark: SparkSession, path: str) -> DataFrame:
    """One row with the totals that have thresholds, and their status; zero if none came."""
    def total(metric: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0))

    return metrics.with_status(per_batch(spark, path).agg(
        total("read").alias("ingested"), total("failed").alias("failed"),
        total("rate_limited").alias("rate_limited"), total("anomalies").alias("anomalies")))


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, after, before)``: micro-batches between two that were reported, but no report.

    Micro-batches without input rows report too, with zeros.
    """
    w = Window.partitionBy("query_id").orderBy("batch_id")    # a row per micro-batch
    batches = per_batch(spark, path).select("query_id", "batch_id").distinct()
    return (batches.select("query_id", F.col("batch_id").alias("after"), F.lead("batch_id").over(w).alias("before"))
            .where("before > after + 1"))
