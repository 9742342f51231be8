"""Running totals of streams, gathered by a listener."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.session import configure
from tallybrook.sources import streams
from tallybrook.sources.tables import Tables
from tallybrook.streaming import jobs, stateful, totals

EVENTS = "id string, user_id string, timestamp timestamp, event_type string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def listener(spark, tmp_path):
    configure(spark)
    made = totals.TotalsListener(spark, f"{tmp_path}/totals")
    spark.streams.addListener(made)
    yield made
    spark.streams.removeListener(made)


def run(spark, tmp_path, listener, slices, start):
    for data in slices:
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert listener.finished(start(streams.file_events(spark, f"{tmp_path}/in", ddl=EVENTS)))


def counted(events, tmp_path, name="one", **counts):
    return (totals.observed(events, **counts).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out")
            .option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(**jobs.ONCE).start())


def event(i, user="u"):
    return str(i), user, START + dt.timedelta(seconds=i), "click"


def test_restarts_go_on_with_the_same_totals(spark, tmp_path, listener):
    slices = [[event(i) for i in range(a, b)] for a, b in ((0, 3), (3, 10), (10, 11))]
    run(spark, tmp_path, listener, slices, lambda events: counted(
        events, tmp_path, read=F.count(F.lit(1)), failed=F.count_if(F.col("id") == "4")))
    assert rows(totals.totals(spark, listener.path), "metric", "total") == [("failed", 1), ("read", 11)]
    found = totals.per_batch(spark, listener.path)
    assert found.select("query_id").distinct().count() == 1
    assert rows(found.where("metric = 'read' and value > 0"), "batch_id", "value") == [(0, 3), (1, 7), (2, 1)]
    assert totals.gaps(spark, listener.path).count() == 0


def test_several_streams_and_repeated_reports(spark, tmp_path, listener):
    run(spark, tmp_path, listener, [[event(0), event(1)]], lambda events: counted(events, tmp_path, read=F.count(F.lit(1))))
    run(spark, tmp_path, listener, [[event(2)]], lambda events: counted(events, tmp_path, "two", read=F.count(F.lit(1)), failed=F.count("id")))
    once = rows(totals.totals(spark, listener.path), "metric", "total")
    assert once == [("failed", 3), ("read", 5)]
    spark.read.parquet(listener.path).cache().write.mode("append").parquet(listener.path)
    assert rows(totals.totals(spark, listener.path), "metric", "total") == once


def test_lost_reports_are_named(spark, tmp_path):
    data = [(q, None, b, START, "read", 1) for q, b in (("a", 0), ("a", 1), ("a", 4), ("a", 5), ("b", 3))]
    spark.createDataFrame(data, totals.TOTALS_DDL).write.parquet(f"{tmp_path}/t")
    assert rows(totals.gaps(spark, f"{tmp_path}/t")) == [("a", 1, 4)]


def test_streams_without_counts_and_empty_tables(spark, tmp_path, listener):
    spark.createDataFrame([], totals.TOTALS_DDL).write.parquet(listener.path)
    run(spark, tmp_path, listener, [[event(0)]], lambda events: events.writeStream.format("parquet").option(
        "path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(**jobs.ONCE).start())
    assert totals.totals(spark, listener.path).count() == 0
    shown = totals.dashboard(spark, listener.path).collect()[0].asDict()
    assert shown["ingested"] == shown["anomalies"] == 0 and shown["failed_status"] == "green"


def test_a_table_that_cannot_be_written_loses_nothing(spark, tmp_path, listener):
    good, listener.path = listener.path, "nowhere://x/y"
    run(spark, tmp_path, listener, [[event(0), event(1)]], lambda events: counted(events, tmp_path, read=F.count(F.lit(1))))
    listener.path = good
    run(spark, tmp_path, listener, [[event(2)]], lambda events: counted(events, tmp_path, read=F.count(F.lit(1))))
    assert rows(totals.totals(spark, good), "metric", "total") == [("read", 3)]


def test_anomalies_that_are_taken_back_do_not_count(spark, tmp_path, listener):
    """A burst is reported, then late events make such bursts usual."""
    def minutes(counts, first=0):
        return [(f"{first}-{i}-{k}", "u", START + dt.timedelta(minutes=first + i, seconds=k % 60), "click")
                for i, n in enumerate(counts) for k in range(n)]

    tables = Tables(f"{tmp_path}/tables")
    slices = [minutes([1] * 12) + minutes([40], first=20), minutes([40] * 5, first=14)]
    run(spark, tmp_path, listener, slices, lambda events: stateful.watch(
        events, tables, f"{tmp_path}/cp", trigger=jobs.ONCE, size="1 minute"))
    stored = tables.read_anomalies(spark).count()
    assert totals.dashboard(spark, listener.path).collect()[0]["anomalies"] == stored > 0
    changes = spark.read.parquet(f"{tmp_path}/tables/anomalies").groupBy("batch_id").agg(F.count_if("withdrawn").alias("back"))
    assert rows(totals.per_batch(spark, listener.path).where("metric = 'anomalies' and batch_id = 0"), "value") == [(1,)]
    assert rows(changes.where("back > 0"), "back") == [(1,)]


def test_throttled_requests(spark, tmp_path, listener):
    from tallybrook.functions.bucket import TokenBucket
    run(spark, tmp_path, listener, [[event(0) for _ in range(120)]], lambda events: stateful.bucket_decisions(
        events.select(F.col("id").cast("bigint").alias("id"), F.col("user_id").alias("api_key"), "timestamp"), TokenBucket())
        .writeStream.format("parquet").option("path", f"{tmp_path}/d").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(**jobs.ONCE).start())
    assert {m: t for m, t, _ in rows(totals.totals(spark, listener.path))} == {"allowed": 100, "rate_limited": 20}
