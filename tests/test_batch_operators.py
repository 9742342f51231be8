import math
import re
import datetime as dt
import json
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.operators import (aggregate, baseline, enrich, ingest, metrics, routing,
                                  toplists, upsert)
from tallybrook.session import configure

EVENT = ("id string, event_type string, user_id string, timestamp timestamp, payload string, "
         "source_ip string, processed_at timestamp")
T0 = dt.datetime(2024, 1, 1, 10)


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-{text}")


def events(spark, items):
    """items: (id, type, user, time[, payload[, processed_at]])"""
    full = [(i, t, u, ts, *(rest or ["{}"])[:1], None, *(rest[1:] or [None]))
            for i, t, u, ts, *rest in items]
    return spark.createDataFrame(full, EVENT)


def test_window_edges(spark):
    df = events(spark, [(str(i), "click", "u", at(t)) for i, t in enumerate(
        ["01 10:00:00", "01 10:00:15", "01 10:00:59", "01 10:01:00"])])
    got = aggregate.window_counts(df)
    assert rows(got, "window_start", "window_end", "count", "window_minutes") == [
        (at("01 10:00"), at("01 10:01"), 3, 1), (at("01 10:01"), at("01 10:02"), 1, 1)]


def test_five_minute_window(spark):
    df = events(spark, [("1", "click", "u", at("01 10:17:37"))])
    got = aggregate.window_counts(df, minutes=5)
    assert rows(got, "window_start", "window_minutes") == [(at("01 10:15"), 5)]


def test_ids_with_separators_are_kept(spark):
    df = events(spark, [("1", "a|b", "u|v|w", T0)])
    assert rows(aggregate.window_counts(df), "user_id", "count") == [("u|v|w", 1)]


def test_rollup_equals_recount(spark):
    rng = random.Random(5)
    df = events(spark, [(str(i), rng.choice("ab"), rng.choice("xyz"),
                         T0 + dt.timedelta(minutes=rng.randrange(6000))) for i in range(500)])
    rollup = aggregate.daily_rollup(aggregate.window_counts(df))
    assert rows(rollup) == rows(aggregate.daily_counts(df))
    check = aggregate.reconcile(df, rollup)
    assert check.where("difference <> 0").count() == 0
    short = aggregate.reconcile(df, rollup.where("user_id <> 'x'"))
    assert {r.user_id for r in short.where("difference <> 0").collect()} == {"x"}


def test_lookup(spark):
    df = events(spark, [("1", "a", "u", at("01 10:00")), ("2", "a", "u", at("02 10:00")),
                        ("3", "b", "u", at("02 10:00")), ("4", "a", "v", at("02 10:00"))])
    daily = aggregate.daily_counts(df)
    assert rows(aggregate.lookup(daily, "u", "a", "2024-01-02", "2024-01-02"),
                "user_id", "event_type", "time_bucket", "event_count") == [
        ("u", "a", "2024-01-02", 1)]
    assert aggregate.lookup(daily, "u").count() == 3


def counts(spark, items):
    return spark.createDataFrame(
        [(u, T0 + dt.timedelta(seconds=30 * i), T0 + dt.timedelta(seconds=30 * i + 30), c)
         for u, i, c in items],
        "user_id string, window_start timestamp, window_end timestamp, count long")


def test_ema_start(spark):
    got = baseline.ema_baseline(counts(spark, [("u", 0, 10), ("u", 1, 20), ("u", 2, 0)]))
    assert [(r.mean, r.variance, r.observations)
            for r in got.orderBy("window_start").collect()] == [
        (0.0, 0.0, 0), (10.0, 0.0, 1), (11.0, 10.0, 2)]


def test_warm_up_then_spike(spark):
    calm = [("u", i, 1) for i in range(10)]
    short = [("v", i, 1) for i in range(9)]
    df = counts(spark, calm + [("u", 10, 50)] + short + [("v", 9, 50)])
    got = baseline.anomalies(baseline.ema_baseline(df)).collect()
    assert [(r.user_id, r.z_score, r.severity, r.observed_value, r.expected_value,
             r.metric) for r in got] == [("u", 49.0, "HIGH", 50.0, 1.0, "event_rate")]
    assert got[0].detected_at == T0 + dt.timedelta(seconds=330)


def test_z_at_threshold_is_no_anomaly(spark):
    df = counts(spark, [("u", i, 1) for i in range(10)] + [("u", 10, 4)])
    assert baseline.anomalies(baseline.ema_baseline(df)).count() == 0
    assert baseline.anomalies(baseline.ema_baseline(df), threshold=2.0).count() == 1


def test_z_score_examples(spark):
    df = spark.createDataFrame([(12,), (15,), (25,)], "count int").select(
        "count", F.lit(10.0).alias("mean"), F.lit(9.0).alias("variance"))
    got = [round(r.z_score, 2) for r in baseline.with_z(df).orderBy("count").collect()]
    assert got == [0.67, 1.67, 5.0]


def test_ema_many_users_equals_loop(spark):
    rng = random.Random(2)
    items = [(f"u{rng.randrange(30)}", i, rng.randrange(50)) for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.user_id, r.window_start): (r.mean, r.variance, r.observations)
               for r in baseline.ema_baseline(counts(spark, items)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    for u, i, c in items:
        mean, var, n = state.get(u, (0.0, 0.0, 0))
        assert got[(u, T0 + dt.timedelta(seconds=30 * i))] == (mean, var, n)
        gap = c - mean
        state[u] = (float(c), 0.0, 1) if n == 0 else (
            0.9 * mean + 0.1 * c, 0.9 * var + 0.1 * gap * gap, n + 1)


def test_enrich(spark):
    configure(spark)
    df = events(spark, [("1", "CLICK", "u", T0, '{"page":"/home","duration":5}')])
    row = enrich.enrich(df).collect()[0]
    assert json.loads(row.payload) == {
        "page": "/home", "duration": 5, "_enriched": True, "_category": "engagement",
        "_payloadSize": 2, "_processedBy": "enrichment-v1"}
    assert row.processed_at is not None


def test_rendered_json_leaves_out_nulls(spark):
    df = events(spark, [("1", "click", "u", T0, '{"a":1}')])
    assert json.loads(enrich.rendered(df).collect()[0].json) == {
        "id": "1", "eventType": "click", "userId": "u",
        "timestamp": "2024-01-01T10:00:00.000000Z", "payload": {"a": 1}}


def message(spark, *texts):
    return routing.parse_messages(
        spark.createDataFrame([(t,) for t in texts], "value string"))


def test_routing_reasons(spark):
    def env(**change):
        body = {"id": "1", "eventType": "click", "userId": "u",
                "timestamp": "2024-01-01T10:00:00Z", "payload": {"a": {"b": 1}}, "source": "web"}
        body.update(change)
        return json.dumps({k: v for k, v in body.items() if v is not None})

    texts = {
        "ok": env(), "malformed_json": "{ this is not valid json }",
        "null_payload": env(payload=None), "payload_not_object": env(payload=[1]),
        "null_event_type": env(eventType=None), "null_timestamp": env(timestamp=None),
        "null_user_id": env(userId=None), "null_id": env(id=None)}
    parsed = message(spark, *texts.values())
    assert {r.raw: r.reason for r in parsed.collect()} == {
        text: (None if name == "ok" else name) for name, text in texts.items()}
    good = routing.good(parsed).collect()
    assert len(good) == 1 and json.loads(good[0].payload) == {"a": {"b": 1}}
    letters = routing.dead_letters(parsed)
    assert letters.count() == 7
    again = routing.replay_dead_letters(
        letters, lambda m: m.withColumn("value", F.regexp_replace(
            "value", r'^\{"id": "1", "userId"', '{"id": "1", "eventType":"x","userId"')))
    assert again.where("reason IS NULL").count() == 1


def requests(spark, items):
    return spark.createDataFrame(
        items, "batch_id long, event_type string, user_id string, payload string")


def test_batch_verdicts(spark):
    good = (1, "click", "u", "{}")
    df = requests(spark, [good] * 3 + [(2, "click", "u", "{}"), (2, "click", "u", None)]
                  + [(3, "click", "u", "{}")] * 101 + [(4, "click", "u", "{}")] * 100)
    got = {r.batch_id: (r.n_events, r.accepted, r.n_accepted, r.reason)
           for r in ingest.batch_verdicts(df).collect()}
    assert got == {1: (3, True, 3, None), 2: (2, False, 0, "invalid event"),
                   3: (101, False, 0, "batch size must not exceed 100 events"),
                   4: (100, True, 100, None)}
    assert ingest.accepted_from_batches(df).count() == 103


def test_flatten_array_batches(spark):
    df = spark.createDataFrame(
        [(1, [("click", "u", "{}"), ("view", "v", "{}")]), (2, []),
         (3, [("click", "u", "{}"), ("click", " ", "{}")])],
        "batch_id int, events array<struct<event_type string, user_id string, payload string>>")
    assert rows(ingest.flatten_batches(df), "batch_id", "position", "user_id") == [
        (1, 0, "u"), (1, 1, "v")]


def test_stamp(spark):
    df = spark.createDataFrame(
        [("click", "u", "{}", "1.2.3.4")] * 2,
        "event_type string, user_id string, payload string, source_ip string")
    got = ingest.stamp(df).collect()
    assert len({r.id for r in got}) == 2
    assert all(r.timestamp is not None and r.processed_at is None for r in got)


def test_user_events_newest_first_with_ties(spark):
    df = events(spark, [("b", "x", "u", at("02 10:00")), ("a", "x", "u", at("02 10:00")),
                        ("c", "y", "u", at("02 11:00")), ("d", "x", "u", at("01 10:59")),
                        ("e", "x", "u", at("01 11:00")), ("f", "x", "v", at("02 11:00"))])
    end = F.lit(at("02 11:00"))
    got = [r.id for r in toplists.user_events(df, "u", end).collect()]
    assert got == ["c", "a", "b", "e"]      # both ends of the range count
    assert [r.id for r in toplists.user_events(df, "u", end, limit=2).collect()] == ["c", "a"]
    assert [r.id for r in toplists.user_events(df, "u", end, event_type="x",
                                               limit=-3).collect()] == ["a"]
    per = toplists.events_per_user(df, end, limit=1)
    assert rows(per, "user_id", "id") == [("u", "c"), ("v", "f")]


def anomaly_rows(spark, items):
    return spark.createDataFrame(
        [(f"2024-01-{h}", at(t), i, u) for i, u, h, t in items],
        "time_bucket string, detected_at timestamp, anomaly_id string, user_id string"
    ).select("*", F.lit("event_rate").alias("metric"), F.lit(1.0).alias("observed_value"),
             F.lit(1.0).alias("expected_value"), F.lit(9.0).alias("z_score"),
             F.lit("HIGH").alias("severity"))


def test_recent_anomalies_limit_is_per_bucket(spark):
    df = anomaly_rows(spark, [
        ("1", "a", "02-10", "02 10:00"), ("2", "b", "02-10", "02 10:40"),
        ("3", "c", "02-10", "02 10:40"), ("4", "d", "02-09", "02 09:05"),
        ("5", "e", "02-08", "02 08:59")])
    now = F.lit(at("02 10:30"))
    two = [r.user_id for r in toplists.recent_anomalies(df, now, hours=2, limit=2).collect()]
    assert two == ["b", "c", "d"]
    assert [r.user_id for r in toplists.recent_anomalies(df, now).collect()] == ["b", "c", "a"]
    assert [r.user_id for r in toplists.user_anomalies(df, "b", "2024-01-02-10").collect()] == ["b"]


def test_upserts(spark):
    df = events(spark, [("1", "x", "u", T0, '{"v":1}', at("02 00:00")),
                        ("1", "x", "u", T0, '{"v":2}', at("03 00:00")),
                        ("1", "x", "u", T0, '{"v":0}', None),
                        ("2", "x", "u", T0, '{"v":3}', at("02 00:00"))])
    assert rows(upsert.upsert_events(df), "id", "payload") == [("1", '{"v":2}'), ("2", '{"v":3}')]
    assert rows(upsert.upsert_instants(df), "id", "payload") == [("1", '{"v":2}')]


def test_retention(spark):
    df = events(spark, [("1", "x", "u", at("01 00:00")), ("2", "x", "u", at("01 00:01")),
                        ("3", "x", "u", at("05 00:00"))])
    now = F.lit(at("08 00:00"))
    assert rows(upsert.retained(df, "timestamp", now, upsert.ANOMALY_DAYS), "id") == [
        ("2",), ("3",)]
    assert rows(upsert.retained(enrich.with_buckets(df), "timestamp", now, 7), "id") == [
        ("2",), ("3",)]


@pytest.mark.parametrize("draw", [
    lambda r: r.lognormal(0, 3, 4000), lambda r: r.integers(0, 3, 4000).astype(float),
    lambda r: np.full(4000, 2.5), lambda r: r.normal(0, 1e-9, 4000) + 1e6,
    lambda r: np.concatenate([r.random(3999), [1e300]]),
    lambda r: r.normal(0, 1, 4000) * 10.0 ** r.integers(-300, 300, 4000),
    lambda r: np.concatenate([np.zeros(3000), -r.random(500), 2.0 ** r.integers(-9, 9, 500)])])
def test_quantiles_equal_numpy(spark, draw):
    rng = np.random.default_rng(4)
    data = {g: draw(rng)[:n] for g, n in (("a", 4000), ("b", 1), ("c", 2), ("d", 777))}
    pairs = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(pairs, "g string, v double").repartition(3)
    got = metrics.quantiles(df, "v", "g", slots=64).collect()
    assert len(got) == 12
    for r in got:
        want = np.quantile(data[r.g], r.quantile)
        assert r.v == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_quantiles_of_endless_values_and_a_null_group(spark):
    inf, nan = float("inf"), float("nan")
    data = {None: [1.0, 2.0, 3.0], "a": [-inf, 1.0, inf], "b": [inf] * 3, "c": [1.0, nan, nan]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {(r.g, r.quantile): r.v for r in metrics.quantiles(df, "v", "g", probs=(0.0, 0.5, 1.0)).collect()}
    assert [got[None, q] for q in (0.0, 0.5, 1.0)] == [1.0, 2.0, 3.0]
    assert [got["a", q] for q in (0.0, 0.5, 1.0)] == [-inf, 1.0, inf] and got["b", 0.5] == inf
    assert got["c", 0.0] == 1.0 and math.isnan(got["c", 1.0])


def test_quantiles_have_one_plan(spark):
    def plan(n):
        df = spark.range(n).selectExpr("id % 3 AS g", "cast(id AS double) AS v")
        text = metrics.quantiles(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"\d+", "", text)

    assert plan(10) == plan(5_000_000)


def test_event_times_and_missing_ids(spark):
    def message(at, i='"1"'):
        return (f'{{"id":{i},"eventType":"click","userId":"u","timestamp":{at},"payload":{{}}}}',)

    rows = [message(a) for a in ('"2024-01-01T00:00:00.123456Z"', "1704067200.123456", "1704067200", '"soon"')]
    got = routing.parse_messages(spark.createDataFrame(rows + [message("1704067200", "null")], "value string")).collect()
    assert [r.reason for r in got] == [None, None, None, "malformed_json", "null_id"]
    assert got[0].timestamp == got[1].timestamp and got[2].timestamp is not None


def test_summary_of_one_instant(spark):
    df = spark.sql("SELECT 'ok' AS outcome, timestamp'2024-01-01 00:00:00' AS timestamp")
    assert metrics.load_summary(df).first().per_1000_sec is None


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.9, 5.0, 10.0, None)], "v double")
    assert rows(metrics.histogram(df, "v", 0, 10, 2), "bucket", "n", "cumulative") == [
        (0, 1, 1), (1, 2, 3), (2, 1, 4), (3, 1, 5)]


def test_totals_rates_and_summary(spark):
    start = at("01 10:00")
    df = spark.createDataFrame(
        [(start + dt.timedelta(seconds=i), o) for i, o in enumerate(
            ["processed"] * 4 + ["failed", "rate_limited"])] +
        [(start + dt.timedelta(seconds=60), "invalid")], "timestamp timestamp, outcome string")
    total = metrics.with_status(metrics.outcome_totals(df)).collect()[0].asDict()
    assert total == {"ingested": 5, "processed": 4, "failed": 1, "rate_limited": 1, "invalid": 1,
                     "ingested_status": "green", "failed_status": "yellow"}
    assert rows(metrics.rates(df), "n", "per_second") == [(1, 1 / 60), (6, 0.1)]
    assert rows(metrics.load_summary(df), "outcome", "n", "per_1000_sec")[0] == ("failed", 1, 116)


def test_processing_delay(spark):
    df = events(spark, [("1", "x", "u", T0, "{}", T0 + dt.timedelta(milliseconds=1500))])
    assert metrics.processing_delay(df).collect()[0].delay_ms == 1500
