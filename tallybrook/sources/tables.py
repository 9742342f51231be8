"""Stored tables: events, counter increments, anomalies, dead letters.

Tables that grow by batches have a folder per batch and time buckets below it. Writing
a batch again replaces its folder, so a retried or replayed batch changes nothing.
Readers prune time buckets in every batch folder; ``compact_events`` merges them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import time as T
from ..operators import upsert

EVENTS_DDL = ("id string, event_type string, user_id string, timestamp timestamp, "
              "payload string, source_ip string, processed_at timestamp, "
              "time_bucket string, batch_id bigint")
INCREMENTS_DDL = ("user_id string, event_type string, window_start timestamp, "
                  "window_end timestamp, window_minutes int, count bigint, "
                  "time_bucket string, batch_id bigint")
ANOMALIES_DDL = ("detected_at timestamp, anomaly_id string, user_id string, metric string, "
                 "observed_value double, expected_value double, z_score double, "
                 "severity string, withdrawn boolean, time_bucket string, batch_id bigint")
COUNTS_DDL = ("user_id string, event_type string, count bigint, time_bucket string, "
              "fold_id bigint")
FOLDS_DDL = "batch_id bigint, fold_id bigint"
DEAD_LETTERS_DDL = "raw string, reason string, failed_at timestamp, batch_id bigint"

ROWS_PER_FILE = 5_000_000


@dataclass(frozen=True)
class Tables:
    """Paths of one set of tables below a common root."""
    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events_by_user"

    @property
    def increments(self) -> str:
        return f"{self.root}/aggregations"

    @property
    def counts(self) -> str:
        """Increments of many batches summed up, a folder per fold."""
        return f"{self.root}/folded_counts"

    @property
    def folds(self) -> str:
        """Which batches a finished fold has taken in."""
        return f"{self.root}/folds"

    @property
    def anomalies(self) -> str:
        return f"{self.root}/anomalies"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letter"

    def read(self, spark: SparkSession, path: str, ddl: str) -> DataFrame:
        return spark.read.schema(ddl).parquet(path)

    def read_stored(self, spark: SparkSession) -> DataFrame:
        """The event table as it lies in its files, replaced rows included."""
        return self.read(spark, self.events, EVENTS_DDL)

    def read_events(self, spark: SparkSession) -> DataFrame:
        """The event table, each key in its last written state.

        Filters on the user, the bucket or the time reach the files.
        """
        stored = self.read_stored(spark)
        return upsert.upsert_events(stored).drop("batch_id")

    def read_counts(self, spark: SparkSession) -> DataFrame:
        """``(user_id, event_type, time_bucket, count)``, to be summed: finished folds, and
        the increments of batches in none of them. Filters on user and bucket reach both."""
        wanted = ["user_id", "event_type", "time_bucket", "count"]
        folds = finished(spark, self.folds, "fold_id")
        if not folds:
            return self.read(spark, self.increments, INCREMENTS_DDL).select(*wanted)
        found = _folders(spark, self.counts, "fold_id", folds, COUNTS_DDL)
        loose = loose_batches(spark, self)
        if loose:
            later = _folders(spark, self.increments, "batch_id", loose, INCREMENTS_DDL)
            found = found.select(*wanted).unionByName(later.select(*wanted))
        return found.select(*wanted)

    def read_counters(self, spark: SparkSession) -> DataFrame:
        """The daily counters: the sum of their increments."""
        return (self.read_counts(spark).groupBy("user_id", "event_type", "time_bucket")
                .agg(F.sum("count").alias("event_count")))

    def read_anomalies(self, spark: SparkSession) -> DataFrame:
        """The anomaly table, each anomaly in its last written state, without withdrawn ones."""
        stored = self.read(spark, self.anomalies, ANOMALIES_DDL)
        last = upsert.latest(stored, ["time_bucket", "anomaly_id"], [F.col("batch_id").desc()])
        return last.where("withdrawn IS NOT TRUE").drop("batch_id", "withdrawn")

    def read_dead_letters(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, self.dead_letters, DEAD_LETTERS_DDL)


def _listed(spark: SparkSession, path: str, pattern: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.globStatus(jvm.Path(root, pattern)) or ()]


def _number(folder) -> int:
    return int(folder.getName().partition("=")[2])


def finished(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the ``name=<number>`` folders of a table that were written to the end."""
    return sorted(_number(p.getParent()) for p in _listed(spark, path, f"{name}=*/_SUCCESS")[1])


def _folders(spark: SparkSession, path: str, name: str, numbers: list[int], ddl: str) -> DataFrame:
    return (spark.read.schema(ddl).option("basePath", path)
            .parquet(*(f"{path}/{name}={n}" for n in numbers)))


def _write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str, name: str = "batch_id") -> None:
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
    if "user_id" in df.columns:     # a lookup skips row groups that cannot hold its user
        writer = writer.option("parquet.bloom.filter.enabled#user_id", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true")
    writer.partitionBy(*partitions).parquet(f"{path}/{name}={batch_id}")


def laid_out(events: DataFrame) -> DataFrame:
    """Day by day, users together, newest first; adds ``time_bucket``.

    The range covers the time as well, so a user with a large share of the events is
    spread over several tasks and files, and row groups still hold narrow user ranges.
    Ranges are found by a sample, which reads the input once more: do costly
    projections, such as the enrichment, on the result.
    """
    keys = ["time_bucket", "user_id", F.col("timestamp").desc(), "id"]
    rows = events.withColumn("time_bucket", T.day_bucket("timestamp"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_events(laid: DataFrame, tables: Tables, batch_id: int = 0) -> None:
    """Writes events that were ``laid_out``."""
    _write_batch(laid, tables.events, batch_id, "time_bucket")


def write_increments(increments: DataFrame, tables: Tables, batch_id: int) -> None:
    keys = ["time_bucket", "user_id", "window_start"]
    rows = increments.withColumn("time_bucket", T.day_bucket("window_start"))
    _write_batch(rows.repartitionByRange(*keys).sortWithinPartitions(*keys),
                 tables.increments, batch_id, "time_bucket")


def write_anomalies(anomalies: DataFrame, tables: Tables, batch_id: int = 0) -> None:
    """Hour buckets, newest first. Another batch adds to an hour, the same one replaces its own."""
    keys = ["time_bucket", F.col("detected_at").desc(), "anomaly_id"]
    _write_batch(anomalies.repartitionByRange(*keys).sortWithinPartitions(*keys),
                 tables.anomalies, batch_id, "time_bucket")


def write_dead_letters(letters: DataFrame, tables: Tables, batch_id: int = 0) -> None:
    _write_batch(letters, tables.dead_letters, batch_id)


# -- folding of increments ------------------------------------------------------
# A stream adds a folder of increments a micro-batch. A fold sums those that are there into
# one folder and then enters their numbers in a ledger. Readers take the folds the ledger
# knows and the increments it does not know, so a fold that was lost on the way counts for
# nothing, and is done again under its number. One fold at a time; a batch in the ledger
# must not change any more, so hold back the newest batch of a stream that runs (``before``).

def _folded_batches(spark: SparkSession, tables: Tables, numbers: list[int]) -> set[int]:
    """Those of the given batches that finished folds have taken in."""
    folds = finished(spark, tables.folds, "fold_id")
    if not folds or not numbers:
        return set()
    ledger = _folders(spark, tables.folds, "fold_id", folds, FOLDS_DDL)
    return {r.batch_id for r in ledger.where(F.col("batch_id").isin(numbers)).select("batch_id").collect()}


def loose_batches(spark: SparkSession, tables: Tables) -> list[int]:
    """Numbers of the increment folders that no finished fold has taken in."""
    here = [_number(p) for p in _listed(spark, tables.increments, "batch_id=*")[1]]
    return sorted(set(here) - _folded_batches(spark, tables, here))


def fold_increments(spark: SparkSession, tables: Tables, before: int | None = None) -> int | None:
    """Sums finished loose batches (numbered under ``before``) into one fold.

    Returns the fold's number, None when there was nothing to fold. A fold has a row per
    user, type and day, in the order of lookups.
    """
    done = set(finished(spark, tables.increments, "batch_id"))
    batches = [b for b in loose_batches(spark, tables) if b in done and (before is None or b < before)]
    if not batches:
        return None
    number = max(finished(spark, tables.folds, "fold_id"), default=-1) + 1
    summed = (_folders(spark, tables.increments, "batch_id", batches, INCREMENTS_DDL)
              .groupBy("user_id", "event_type", "time_bucket").agg(F.sum("count").alias("count")))
    keys = ["time_bucket", "user_id", "event_type"]
    _write_batch(summed.repartitionByRange(*keys).sortWithinPartitions(*keys), tables.counts,
                 number, "time_bucket", name="fold_id")
    ledger = spark.createDataFrame([(b,) for b in batches], "batch_id bigint").coalesce(1)
    _write_batch(ledger, tables.folds, number, name="fold_id")
    return number


def drop_folded(spark: SparkSession, tables: Tables) -> int:
    """Removes increment folders that a finished fold has taken in; returns how many."""
    fs, folders = _listed(spark, tables.increments, "batch_id=*")
    folded = _folded_batches(spark, tables, [_number(p) for p in folders])
    gone = [p for p in folders if _number(p) in folded]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)


def compact_events(spark: SparkSession, tables: Tables, into: Tables) -> None:
    """The event table rewritten with one row per key, to a new set of tables."""
    write_events(laid_out(tables.read_events(spark)), into)
