import datetime as dt

from pyspark.sql import functions as F

from tallybrook.functions.bucket import TokenBucket
from tallybrook.functions.time import micros
from tallybrook.operators import ingest, throttle
from tallybrook.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
DDL = ("id long, timestamp timestamp, batch_id long, event_type string, user_id string, "
       "payload string, api_key string, x_forwarded_for string, remote_addr string")


def request(i, batch=None, key="k", seconds=0, event_type="click", at=True):
    return (i, T0 + dt.timedelta(seconds=seconds) if at else None, batch, event_type, "u",
            "{}", key, None, f"192.0.2.{i % 250}")


def outcomes(judged):
    return {(r.batch_id, r.id): r.outcome for r in judged.collect()}


def test_a_batch_takes_one_token(spark):
    rows = [request(i, batch=1) for i in range(50)] + [request(100), request(101)]
    df = spark.createDataFrame(rows, DDL)
    judged = ingest.judge(df, TokenBucket(2, 1))
    assert outcomes(judged) == {(1, 0): "accepted", (None, 100): "accepted",
                                (None, 101): "rate_limited"}
    assert ingest.accepted_events(df, judged, replay=True).count() == 51


def test_invalid_calls_take_no_token(spark):
    rows = [request(1, event_type=""), request(2, batch=7), request(3, batch=7, event_type=None),
            *(request(100 + i, batch=8) for i in range(101)), request(900)]
    df = spark.createDataFrame(rows, DDL)
    judged = ingest.judge(df, TokenBucket(1, 1))
    assert outcomes(judged) == {(None, 1): "invalid", (7, 2): "invalid", (8, 100): "invalid",
                                (None, 900): "accepted"}
    assert [r.id for r in ingest.accepted_events(df, judged, replay=True).collect()] == [900]


def test_calls_without_key_or_time_and_without_rows(spark):
    df = spark.createDataFrame([request(1, key=None), request(2, key=None), request(3, at=False)], DDL)
    judged = ingest.judge(df, TokenBucket(1, 1))
    assert outcomes(judged) == {(None, 1): "accepted", (None, 2): "rate_limited", (None, 3): "accepted"}
    assert {r.api_key for r in judged.collect()} == {ingest.ANONYMOUS, "k"}
    none = df.limit(0)
    assert ingest.accepted_events(none, ingest.judge(none)).count() == 0


def test_stream_hands_tokens_on(spark, tmp_path):
    source = str(tmp_path / "in")
    for n, rows in enumerate([[request(1), request(2)], [request(3), request(4, seconds=5)]]):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DDL).parquet(source)
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), TokenBucket(1, 1),
                           replay=True, trigger=jobs.ONCE).awaitTermination()
    calls = spark.read.parquet(str(tmp_path / "out/calls"))
    assert {r.id: r.outcome for r in calls.collect()} == {
        1: "accepted", 2: "rate_limited", 3: "rate_limited", 4: "accepted"}
    sent = spark.read.parquet(str(tmp_path / "out/messages"))
    assert {r.id for r in sent.select(F.get_json_object("value", "$.id").alias("id")).collect()} == {"1", "4"}


def test_a_burst_is_cut_by_requests(spark):
    """998 of 1,000 requests lie within a second of a long log."""
    times = [0, *(50_000_000 + 1000 * i for i in range(998)), 100_000_000_000]
    rows = [(i, "hot", T0 + dt.timedelta(microseconds=t)) for i, t in enumerate(times)]
    rows += [(2000 + i, "hot", None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, api_key string, timestamp timestamp")
    timed = df.withColumn(throttle._T, micros("timestamp"))
    busy = throttle._busy_keys(timed, "api_key", 100, 50, None)
    placed = throttle._place(timed, busy, "api_key", "id", "left").groupBy(
        throttle._BLOCK).count().collect()
    assert max(r["count"] for r in placed) <= 150 and len(placed) > 100
    got = {r.id: r.allowed for r in throttle.replay(df, busy_rows=100, stretch_rows=50).collect()}
    assert got == {r.id: r.allowed for r in throttle.replay(df).collect()}
