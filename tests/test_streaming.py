import datetime as dt
import os
import random
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.functions.bucket import TokenBucket
from tallybrook.operators import aggregate, baseline, enrich, routing, throttle
from tallybrook.session import configure
from tallybrook.sources import adapter, streams, synthetic, tables as stored
from tallybrook.sources.tables import Tables
from tallybrook.streaming import jobs

DDL = "id string, user_id string, timestamp timestamp, event_type string"


def at(text):
    return dt.datetime.fromisoformat(f"2024-{text}")


def drop_files(df_list, folder, kind="parquet"):
    """One file per frame, in order of modification time."""
    for n, df in enumerate(df_list):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        getattr(df.coalesce(1).write.mode("append"), kind)(folder)
        for name in set(os.listdir(folder)) - before:
            os.utime(f"{folder}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))


def parts(df, n, order="event_id"):
    """The frame cut into n consecutive parts."""
    data = df.orderBy(order).collect()
    size = -(-len(data) // n)
    return [df.sparkSession.createDataFrame(data[i * size:(i + 1) * size], df.schema)
            for i in range(n)]


def finish(query):
    query.awaitTermination()
    return query


@pytest.fixture
def raw(spark, sf):
    configure(spark)
    return adapter.raw_events(spark, sf)


def test_event_tables_equal_batch(spark, raw, tmp_path):
    messages = adapter.as_raw_messages(raw)
    cut = [adapter.as_raw_messages(p).select("value") for p in parts(raw, 3)]
    drop_files(cut, f"{tmp_path}/in", "text")
    tables = Tables(f"{tmp_path}/tables")
    query = finish(jobs.process_events(streams.file_messages(spark, f"{tmp_path}/in", 1), tables,
                                       f"{tmp_path}/cp", jobs.ONCE))
    progress = [p.observedMetrics["outcomes"] for p in query.recentProgress
                if "outcomes" in p.observedMetrics]
    parsed = routing.parse_messages(messages)
    good = routing.good(parsed)
    assert sum(p.read for p in progress) == raw.count()
    assert sum(p.failed for p in progress) == routing.dead_letters(parsed).count()

    columns = ["id", "user_id", "event_type", "timestamp", "payload"]
    assert rows(tables.read_events(spark), *columns) == rows(enrich.enrich(good), *columns)
    keys = ["user_id", "event_type", "time_bucket", "event_count"]
    assert rows(tables.read_counters(spark), *keys) == rows(aggregate.daily_counts(good), *keys)
    assert rows(tables.read_dead_letters(spark), "raw", "reason") == rows(
        routing.dead_letters(parsed), "raw", "reason")
    check = aggregate.reconcile(tables.read_events(spark), tables.read_counters(spark))
    assert check.where("difference <> 0").count() == 0

    # a batch written again, as after a crash, changes nothing
    before = rows(tables.read_counters(spark), *keys)
    first = routing.parse_messages(cut[0])
    stored.write_increments(aggregate.window_counts(routing.good(first)), tables, 0)
    stored.write_events(enrich.enrich(stored.laid_out(routing.good(first))), tables, 0)
    stored.write_dead_letters(routing.dead_letters(first), tables, 0)
    assert rows(tables.read_counters(spark), *keys) == before
    assert tables.read_dead_letters(spark).count() == routing.dead_letters(parsed).count()
    assert tables.read_events(spark).count() == good.count()

    into = Tables(f"{tmp_path}/compact")
    stored.compact_events(spark, tables, into)
    assert rows(into.read_events(spark), *columns) == rows(tables.read_events(spark), *columns)

    days = {r.time_bucket for r in tables.read_events(spark).select("time_bucket").collect()}
    dropped = jobs.drop_expired(spark, tables.events, "2024-01-10")
    assert dropped == sorted(d for d in days if d < "2024-01-10")
    assert {r.time_bucket for r in tables.read_events(spark).select("time_bucket").distinct()
            .collect()} == {d for d in days if d >= "2024-01-10"}


def test_failed_batch_is_redone_without_double_counts(spark, raw, tmp_path, monkeypatch):
    drop_files([adapter.as_raw_messages(p).select("value") for p in parts(raw, 2)],
               f"{tmp_path}/in", "text")
    tables, write, calls = Tables(f"{tmp_path}/tables"), stored.write_dead_letters, []

    def fail_once(letters, into, batch_id):
        calls.append(batch_id)
        if calls == [0, 1]:     # events and increments of batch 1 are written by now
            raise RuntimeError("lost")
        write(letters, into, batch_id)

    monkeypatch.setattr(stored, "write_dead_letters", fail_once)

    def run():
        finish(jobs.process_events(streams.file_messages(spark, f"{tmp_path}/in", 1), tables,
                                   f"{tmp_path}/cp", jobs.ONCE))

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert calls == [0, 1, 1]
    parsed = routing.parse_messages(adapter.as_raw_messages(raw))
    keys = ["user_id", "event_type", "time_bucket", "event_count"]
    assert rows(tables.read_counters(spark), *keys) == rows(
        aggregate.daily_counts(routing.good(parsed)), *keys)
    assert tables.read_dead_letters(spark).count() == routing.dead_letters(parsed).count()


def test_no_closed_window_yet(spark, raw, tmp_path):
    drop_files([raw.where("event_id = 0")], f"{tmp_path}/in")
    tables = Tables(f"{tmp_path}/tables")
    events = adapter.as_events(streams.file_events(spark, f"{tmp_path}/in"))
    finish(jobs.close_windows(events, f"{tmp_path}/windows", f"{tmp_path}/cp1",
                              trigger=jobs.ONCE))
    finish(jobs.detect_anomalies(spark, f"{tmp_path}/windows", tables, f"{tmp_path}/cp2",
                                 trigger=jobs.ONCE))
    assert tables.read_anomalies(spark).count() == 0


def test_anomaly_table(spark, raw, tmp_path):
    counts = aggregate.user_counts(adapter.as_events(raw), "1 day")
    found = baseline.anomalies(baseline.ema_baseline(counts), threshold=2.0).withColumns({
        "user_id": F.col("user_id").cast("string"),
        "detected_at": F.col("detected_at").cast("timestamp")})
    tables = Tables(str(tmp_path))
    for _ in range(2):
        stored.write_anomalies(found, tables)
    columns = ["time_bucket", "anomaly_id", "detected_at", "z_score"]
    assert rows(tables.read_anomalies(spark), *columns) == rows(found, *columns)
    more = found.withColumn("anomaly_id", F.concat(F.lit("again-"), "anomaly_id"))
    stored.write_anomalies(more, tables, 1)
    assert tables.read_anomalies(spark).count() == 2 * found.count()
    oldest = found.agg(F.max("time_bucket")).first()[0]
    assert jobs.drop_expired(spark, tables.anomalies, oldest)
    kept = found.where(F.col("time_bucket") == oldest)
    assert tables.read_anomalies(spark).count() == 2 * kept.count()


def test_late_events_are_counted_by_the_default_path(spark, tmp_path):
    configure(spark)
    batches = [["01-01 12:00", "01-02 12:00"], ["01-02 06:00", "01-02 13:00"],
               ["01-02 05:00", "01-04 00:00"], ["01-02 04:00", "01-05 12:00"]]
    n, frames = 0, []
    for batch in batches:
        data = []
        for text in batch:
            n += 1
            data.append((str(n), "u", at(text), "click"))
        frames.append(spark.createDataFrame(data, DDL))
    drop_files(frames, f"{tmp_path}/in")
    events = streams.file_events(spark, f"{tmp_path}/in", 1, DDL)
    messages = enrich.keyed_messages(events.withColumns({
        "payload": F.lit("{}"), "source_ip": F.lit(None).cast("string"),
        "processed_at": F.lit(None).cast("timestamp")}))
    tables = Tables(f"{tmp_path}/tables")
    finish(jobs.process_events(messages, tables, f"{tmp_path}/cp", jobs.ONCE))
    assert rows(tables.read_counters(spark), "time_bucket", "event_count") == [
        ("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-04", 1), ("2024-01-05", 1)]

    # closed windows: five rows of the still open day count, the last day stays open
    finish(jobs.close_windows(events, f"{tmp_path}/windows", f"{tmp_path}/cp2", size="1 day",
                              trigger=jobs.ONCE))
    closed = spark.read.parquet(f"{tmp_path}/windows")
    assert rows(closed.select(F.date_format("window_start", "MM-dd"), "count")) == [
        ("01-01", 1), ("01-02", 5), ("01-04", 1)]


def test_anomalies_equal_batch_on_closed_windows(spark, raw, tmp_path):
    drop_files(parts(raw, 3), f"{tmp_path}/in")
    events = adapter.as_events(streams.file_events(spark, f"{tmp_path}/in", 1))
    tables = Tables(f"{tmp_path}/tables")
    for _ in range(2):      # the second round picks up where the first one stopped
        finish(jobs.close_windows(events, f"{tmp_path}/windows", f"{tmp_path}/cp1", size="1 day",
                                  trigger=jobs.ONCE))
        finish(jobs.detect_anomalies(spark, f"{tmp_path}/windows", tables, f"{tmp_path}/cp2",
                                     threshold=2.0, trigger=jobs.ONCE))
    counts = aggregate.user_counts(adapter.as_events(raw), "1 day")
    last = raw.agg(F.max("ts")).collect()[0][0] - dt.timedelta(hours=1)
    want = (baseline.anomalies(baseline.ema_baseline(counts), threshold=2.0)
            .where(F.col("detected_at") <= F.lit(last))
            .withColumns({"user_id": F.col("user_id").cast("string"),
                          "detected_at": F.col("detected_at").cast("timestamp")}))
    columns = ["anomaly_id", "user_id", "detected_at", "observed_value", "expected_value",
               "z_score", "severity", "time_bucket"]
    got = rows(tables.read_anomalies(spark), *columns)
    assert got and got == rows(want, *columns)


@pytest.mark.parametrize("busy", [10**6, 30])
def test_throttle_equals_batch(spark, raw, tmp_path, busy):
    bucket = TokenBucket(5, 2)
    rng = random.Random(9)
    t, data = 0.0, []
    for i in range(600):
        t += rng.expovariate(5)
        data.append((str(i).zfill(4), rng.choice("aab"), at("01-01") + dt.timedelta(
            microseconds=int(t * 1e6))))
    ddl = "id string, api_key string, timestamp timestamp"
    df = spark.createDataFrame(data, ddl)
    drop_files(parts(df, 4, "timestamp"), f"{tmp_path}/in")
    finish(jobs.throttle_stream(streams.file_events(spark, f"{tmp_path}/in", 1, ddl),
                                f"{tmp_path}/out", f"{tmp_path}/cp", bucket, keep="10 seconds",
                                trigger=jobs.ONCE, busy_rows=busy))
    got = spark.read.parquet(f"{tmp_path}/out/decisions")
    assert rows(got, "id", "allowed", "tokens_left") == rows(
        throttle.replay(df, bucket), "id", "allowed", "tokens_left")
    assert 0 < got.where("NOT allowed").count() < 600
    # allowed requests stay within capacity plus refill
    span = (data[-1][2] - data[0][2]).total_seconds()
    for r in got.where("allowed").groupBy("api_key").count().collect():
        assert r["count"] <= 5 + 2 * span


def test_live_counts_and_repeats(spark, raw, tmp_path):
    drop_files(parts(raw, 3) + parts(raw, 3)[2:], f"{tmp_path}/in")
    events = adapter.as_events(streams.file_events(spark, f"{tmp_path}/in", 1))
    finish(jobs.without_repeats(events, "30 days").select("id").writeStream.format("parquet")
           .option("path", f"{tmp_path}/kept").option("checkpointLocation", f"{tmp_path}/cp")
           .trigger(availableNow=True).start())
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert kept.count() == kept.distinct().count() == raw.count()

    once = f"{tmp_path}/once"
    drop_files(parts(raw, 3), once)
    live = jobs.live_window_counts(adapter.as_events(streams.file_events(spark, once, 1)))
    name = f"live_{int(time.time())}"
    finish(live.writeStream.format("memory").queryName(name).outputMode("update")
           .option("checkpointLocation", f"{tmp_path}/cp3").trigger(availableNow=True).start())
    # update mode repeats a key: its newest value is the largest
    newest = (spark.table(name).groupBy("user_id", "event_type", "window_start")
              .agg(F.max("count").alias("count")))
    want = aggregate.window_counts(adapter.as_events(raw)).withColumn(
        "window_start", F.col("window_start").cast("timestamp"))
    columns = ["user_id", "event_type", "window_start", "count"]
    assert rows(newest, *columns) == rows(want, *columns)


def test_synthetic_sources(spark, tmp_path):
    df = synthetic.batch_source(spark, 2000, 4).cache()
    assert rows(df) == rows(synthetic.batch_source(spark, 2000, 3))
    assert df.select("user_id").distinct().count() == 100
    assert {r[0] for r in df.select("event_type").distinct().collect()} == set(
        synthetic.EVENT_TYPES)
    duration = F.get_json_object("payload", "$.duration").cast("int")
    low, high = df.agg(F.min(duration), F.max(duration)).collect()[0]
    assert 0 <= low < 20 and 280 < high < 300
    query = (synthetic.stream_source(spark, 50).writeStream.format("memory").queryName("rate_rows")
             .trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("rate_rows").count() == 0:
            time.sleep(1)
    finally:
        query.stop()
    assert spark.table("rate_rows").where("user_id LIKE 'user-%'").count() > 0
