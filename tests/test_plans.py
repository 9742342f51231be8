"""Properties of the physical plans that matter at scale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import aggregate, enrich, throttle, toplists, upsert
from tallybrook.plans import catalog
from tallybrook.sources import adapter, tables as stored
from tallybrook.sources.tables import Tables


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_counts_read_two_columns_and_combine_before_the_shuffle(spark, sf):
    text = plan(aggregate.user_counts(adapter.load_events(spark, sf)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text
    assert text.count("Exchange\n") <= 2 and "partial_count" in text


def test_newest_per_user_limits_before_the_shuffle(spark, sf):
    text = plan(catalog.QUERIES["recent_events_per_user"](spark, sf))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_upsert_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(upsert.upsert_events(adapter.load_events(spark, sf)))


def test_user_events_push_filters_and_take_ordered(spark, sf):
    events = adapter.load_events(spark, sf)
    end = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")
    text = plan(toplists.user_events(events, 7, end))
    assert "TakeOrderedAndProject" in text and "EqualTo(user_id,7)" in text
    assert "GreaterThanOrEqual(ts" in text


def test_stored_events_prune_day_buckets(spark, sf, tmp_path):
    events = adapter.load_events(spark, sf).withColumns({
        "id": F.col("id").cast("string"), "user_id": F.col("user_id").cast("string"),
        "timestamp": F.col("timestamp").cast("timestamp")})
    tables = Tables(str(tmp_path))
    stored.write_events(enrich.enrich(stored.laid_out(events)), tables)
    end = F.lit(dt.datetime(2024, 1, 20, 12))
    found = toplists.user_events(tables.read_events(spark), "7", end, hours=48)
    text = plan(found)
    filters = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert filters and all("time_bucket" in line for line in filters)
    assert [r.id for r in found.collect()] == [
        r.id for r in toplists.user_events(events, "7", end, hours=48).collect()]


def test_no_cross_joins(spark, sf):
    for name in ("throttle_decisions", "latency_quantiles", "reconcile", "batch_flattened"):
        if name in catalog.QUERIES:
            text = plan(catalog.QUERIES[name](spark, sf))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_busy_list_is_all_that_is_broadcast(spark, sf):
    requests = adapter.as_requests(adapter.raw_events(spark, sf))
    text = plan(throttle.replay(requests.select("id", "timestamp", "api_key")))
    assert "TakeOrderedAndProject" in text and str(throttle.MAX_BUSY) in text
    assert "SortMergeJoin" not in text


@pytest.mark.parametrize("copies", [1, 4000])
def test_many_copies_of_one_event(spark, copies):
    base = spark.range(copies).select(
        F.lit("1").alias("id"), F.lit("u").alias("user_id"),
        F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"),
        F.col("id").cast("string").alias("payload"),
        F.timestamp_seconds(F.col("id")).alias("processed_at")).repartition(8)
    got = upsert.upsert_events(base).collect()
    assert [r.payload for r in got] == [str(copies - 1)]
