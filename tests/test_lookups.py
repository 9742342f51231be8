"""Lookups on stored tables: results, buckets and files opened, order in the files; sliding rates."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.operators import aggregate, metrics, toplists
from tallybrook.sources import adapter, lookups, tables as stored
from tallybrook.sources.tables import Tables

NOW = dt.datetime(2024, 1, 30, 12)
NAMES = ["id", "event_type", "timestamp"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Thirty days of twenty users in two batches; the second writes some rows anew."""
    tables = Tables(str(tmp_path_factory.mktemp("lookups")))
    events = spark.range(12000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.floor(F.col("id") / 7) % 3).alias("event_type"),
        F.concat(F.lit("user-"), F.col("id") % 20).alias("user_id"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=(F.col("id") * 3.59).cast("int"))).alias("timestamp"),
        F.lit("{}").alias("payload"), F.lit("ip").alias("source_ip"), F.lit(NOW).cast("timestamp").alias("processed_at"))
    for batch, some in enumerate((events, events.where("id % 5 = 0").withColumn("payload", F.lit('{"again":1}')))):
        some = some.withColumn("processed_at", F.col("processed_at") + F.make_dt_interval(secs=F.lit(batch)))
        stored.write_events(stored.laid_out(some), tables, batch)
    stored.write_increments(aggregate.window_counts(events), tables, 0)
    return tables


def scans(df):
    """Metrics of the file scans of a query that has run."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            found.append({name: node.metrics().apply(name).value() for name in ("numFiles", "numPartitions", "numOutputRows")
                          if node.metrics().contains(name)})
        for child in (node.finalPhysicalPlan(),) if hasattr(node, "finalPhysicalPlan") and "Adaptive" in node.nodeName() else ():
            walk(child)
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


@pytest.mark.parametrize("hours,limit,kind", [(24, 5, None), (168, 1000, None), (168, 40, "t1"), (500, 3, None)])
def test_user_events_equal_the_full_sort(spark, table, hours, limit, kind):
    got = lookups.user_events(spark, table, "user-4", NOW, hours=hours, limit=limit, event_type=kind)
    want = toplists.user_events(table.read_events(spark), "user-4", F.lit(NOW).cast("timestamp"), hours=hours,
                                limit=limit, event_type=kind)
    assert got.select(NAMES).collect() == want.select(NAMES).collect()
    assert 0 < got.count() <= limit


def test_rows_written_again_are_the_last_ones(spark, table):
    got = lookups.user_events(spark, table, "user-10", NOW, hours=168, limit=1000)
    assert {r.payload for r in got.collect()} == {'{"again":1}'}


def test_older_buckets_are_not_opened(spark, table):
    """20 rows a user and day: three rows need the newest day only, fifty need three, sixty seven."""
    day = lookups.days_between(NOW - dt.timedelta(hours=168), NOW)
    mine = table.read_events(spark).where("user_id = 'user-4'")
    assert lookups.until_enough(mine, day, 3) == day[:1]
    assert lookups.until_enough(mine, day, 50) == day[:3]
    assert lookups.until_enough(mine, day, 60) == day[:7]
    assert lookups.until_enough(mine, day, 10_000) == day
    assert lookups.until_enough(mine, [], 5) == []
    few = lookups.user_events(spark, table, "user-4", NOW, hours=168, limit=3)
    few.collect()
    parts = sum(s["numPartitions"] for s in scans(few))
    assert 0 < parts <= 2      # a day, in two batches at most


def test_filters_reach_folders_and_row_groups(spark, table):
    found = lookups.counter(spark, table, "user-4", "t1", "2024-01-20", "2024-01-22")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(time_bucket" in plan and "EqualTo(user_id,user-4)" in plan
    found.collect()
    assert sum(s["numPartitions"] for s in scans(found)) == 3
    files = table.read_stored(spark).where("time_bucket = '2024-01-20'")
    one = files.where("user_id = 'user-4'")
    one.collect()
    assert sum(s["numOutputRows"] for s in scans(one)) <= files.count()


def test_absent_users_are_ruled_out_by_the_bloom_filter(spark, table):
    """The name lies within the range of every row group, yet no row is read."""
    none = table.read_stored(spark).where("user_id = 'user-11x'").select("id")
    assert none.collect() == [] and sum(s["numOutputRows"] for s in scans(none)) == 0


def test_counters_equal_the_rollup(spark, table):
    events = table.read_events(spark)
    got = lookups.counter(spark, table, "user-4", None, "2024-01-10", "2024-01-20")
    want = aggregate.lookup(aggregate.daily_counts(events), "user-4", None, "2024-01-10", "2024-01-20")
    assert rows(got, "event_type", "time_bucket", "event_count") == rows(want, "event_type", "time_bucket", "event_count")


def test_newest_event_and_order(spark, table):
    assert lookups.newest(spark, table) == table.read_stored(spark).agg(F.max("timestamp").cast("timestamp_ntz")).first()[0]
    assert lookups.newest(spark, Tables("/tmp/no-such-table")) is None
    order = lookups.disorder(table.read_stored(spark))
    assert order.where("out_of_order <> 0").count() == 0 and order.agg(F.sum("n")).first()[0] == 14400


def test_disorder_is_seen(spark, tmp_path):
    tables = Tables(str(tmp_path))
    data = [(str(i), "u", NOW + dt.timedelta(minutes=i)) for i in range(5)]
    df = spark.createDataFrame(data, "id string, user_id string, timestamp timestamp").coalesce(1)
    df.withColumn("time_bucket", F.lit("2024-01-30")).write.partitionBy("time_bucket").parquet(f"{tables.events}/batch_id=0")
    assert rows(lookups.disorder(tables.read_stored(spark))) == [("2024-01-30", 5, 4)]


def test_anomaly_lookups(spark, tmp_path):
    tables = Tables(str(tmp_path))
    hours = [NOW - dt.timedelta(hours=h) for h in (0, 0, 1, 3, 30)]
    data = [(f"{t:%Y-%m-%d-%H}", t, f"a{i}", f"u{i % 2}", "event_rate", 9.0, 1.0, 4.0, "MEDIUM") for i, t in enumerate(hours)]
    found = spark.createDataFrame(data, "time_bucket string, detected_at timestamp, anomaly_id string, user_id string, "
                                        "metric string, observed_value double, expected_value double, z_score double, severity string")
    stored.write_anomalies(found, tables)
    got = lookups.recent_anomalies(spark, tables, NOW, hours=4, limit=1)
    assert [r.user_id for r in got.collect()] == ["u0", "u0", "u1"]
    assert sum(s["numPartitions"] for s in scans(got)) <= 3
    assert [r.anomaly_id for r in lookups.user_hour_anomalies(spark, tables, "u1", f"{NOW:%Y-%m-%d-%H}").collect()] == ["a1"]
    assert lookups.user_hour_anomalies(spark, tables, "u1", "2020-01-01-00").count() == 0


# -- sliding rates ------------------------------------------------------------------

def test_sliding_rates_by_hand(spark):
    at = [0, 1, 14, 15, 50, 200, None]
    data = [(None if s is None else NOW + dt.timedelta(seconds=s), "x") for s in at]
    found = metrics.sliding_rates(spark.createDataFrame(data, "timestamp timestamp_ntz, kind string"), ["kind"])
    seconds = {int((r.at.replace(tzinfo=None) - NOW).total_seconds()): r.n for r in found.collect()}
    assert seconds == {15: 3, 30: 4, 45: 4, 60: 5, 75: 2, 90: 1, 105: 1, 210: 1, 225: 1, 240: 1, 255: 1}
    with pytest.raises(ValueError):
        metrics.sliding_rates(found, every=40)


def test_sliding_rates_read_the_input_once(spark, sf):
    plan = metrics.sliding_rates(adapter.load_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan
