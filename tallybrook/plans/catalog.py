"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each runs over the whole table. Names and column names match ``oracle.sql()``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import time as T
from ..functions.bucket import TokenBucket
from ..operators import aggregate, baseline, enrich, ingest, metrics, routing, throttle
from ..operators import profiles, sketches, toplists, upsert
from ..session import configure, workspace
from ..sources import adapter, lookups, replay, streams, synthetic, tables as table
from ..sources.tables import INCREMENTS_DDL, Tables
from ..streaming import jobs, stateful, totals

# The test events are thin (about 2.5 per active user and day). Day windows and a
# small, slow bucket make the folds do something. The operators' defaults are 30
# seconds, and 100 tokens refilled at 20 a second.
DAY = "1 day"
SLOW = TokenBucket(5, Fraction(2, 86400))
LOOKUP_USER = 7
ANOMALY_USER, ANOMALY_HOUR = 97, "2024-01-18-00"
RETAIN_DAYS = 7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def _requests(spark, sf):
    return adapter.as_requests(adapter.raw_events(spark, sf))


def _parsed(spark, sf):
    return routing.parse_messages(adapter.as_raw_messages(adapter.raw_events(spark, sf)))


# -- counts -----------------------------------------------------------------

@query
def user_type_minute_counts(spark, sf):
    return aggregate.window_counts(adapter.load_events(spark, sf))


@query
def user_type_five_minute_counts(spark, sf):
    return aggregate.window_counts(adapter.load_events(spark, sf), minutes=5)


@query
def user_type_daily_rollup(spark, sf):
    return aggregate.daily_counts(adapter.load_events(spark, sf))


@query
def type_daily_counts(spark, sf):
    return aggregate.type_counts(adapter.load_events(spark, sf), "day")


@query
def type_hourly_counts(spark, sf):
    return aggregate.type_counts(adapter.load_events(spark, sf), "hour")


@query
def user_aggregation_lookup(spark, sf):
    events = adapter.load_events(spark, sf)
    counters = aggregate.daily_counts(events)
    now = toplists.newest(events)
    week = T.day_bucket(T.hours_before(now, T.clamp(500, *toplists.EVENT_HOURS)))
    return aggregate.lookup(counters, LOOKUP_USER, "view", week, T.day_bucket(now))


@query
def user_30s_counts(spark, sf):
    return aggregate.user_counts(adapter.load_events(spark, sf)).drop("window_end")


@query
def recount_vs_rollup(spark, sf):
    events = adapter.load_events(spark, sf)
    stored = aggregate.daily_rollup(aggregate.window_counts(events))
    return aggregate.reconcile(events, stored)


# -- enrichment -------------------------------------------------------------

@query
def enriched_events(spark, sf):
    events = enrich.with_buckets(enrich.enrich(adapter.load_events(spark, sf)))
    merged = F.from_json("payload", "_category string, _payloadSize int, _enriched boolean, "
                                    "_processedBy string, k int")
    return events.withColumn("m", merged).select(
        "id", "time_bucket", "hour_bucket",
        F.col("m._category").alias("category"), F.col("m._payloadSize").alias("payload_size"),
        F.col("m._enriched").alias("enriched"), F.col("m._processedBy").alias("processed_by"),
        F.col("m.k").alias("k"),
        F.size(F.json_object_keys("payload")).alias("keys_after"),
        F.col("processed_at").isNotNull().alias("processed"),
        T.window_start("timestamp").alias("window_start"),
    )


@query
def profiled_events(spark, sf):
    return profiles.with_profiles(adapter.load_events(spark, sf), adapter.user_profiles(spark, sf)).select(
        "id", "user_id", "segment", "nation")


@query
def rendered_events(spark, sf):
    """Fields read back from the rendered JSON."""
    json = enrich.rendered(adapter.load_events(spark, sf)).select("id", "json")
    return json.select(
        "id",
        F.get_json_object("json", "$.eventType").alias("event_type"),
        F.get_json_object("json", "$.userId").alias("user_id"),
        F.get_json_object("json", "$.timestamp").alias("ts_text"),
        F.get_json_object("json", "$.payload.k").cast("int").alias("k"),
        F.size(F.json_object_keys("json")).alias("n_fields"),
    )


# -- requests ---------------------------------------------------------------

@query
def validated_requests(spark, sf):
    return (ingest.validate(_requests(spark, sf))
            .select("id", "is_valid", F.size("violations").alias("n_violations")))


@query
def violation_messages(spark, sf):
    return (ingest.validate(_requests(spark, sf)).where("NOT is_valid")
            .select("id", F.concat_ws("; ", "violations").alias("messages")))


@query
def batch_acceptance(spark, sf):
    return ingest.batch_verdicts(_requests(spark, sf))


@query
def batch_flattened(spark, sf):
    return ingest.accepted_from_batches(_requests(spark, sf)).select(
        "id", "batch_id", "event_type", "user_id")


@query
def array_batch_verdicts(spark, sf):
    """Batches as arrays: every one has a verdict, with messages for each element."""
    return ingest.array_verdicts(adapter.as_request_arrays(_requests(spark, sf))).withColumn(
        "messages", F.array_join("messages", "; "))


@query
def array_batch_events(spark, sf):
    return ingest.flatten_batches(adapter.as_request_arrays(_requests(spark, sf))).select(
        "batch_id", "position", "id", "user_id")


@query
def client_ip(spark, sf):
    return (ingest.with_client(_requests(spark, sf))
            .select("id", "source_ip", "api_key"))


@query
def stamped_events(spark, sf):
    valid = ingest.validate(_requests(spark, sf)).where("is_valid")
    return (ingest.stamp(ingest.with_client(valid), replay=True)
            .select("id", "event_type", "user_id", "timestamp", "source_ip",
                    F.col("processed_at").isNull().alias("unprocessed")))


@query
def dead_letter_routing(spark, sf):
    parsed = _parsed(spark, sf)
    return parsed.select(
        F.regexp_extract("raw", r'"id":"(\d+)"', 1).try_cast("bigint").alias("id"),
        F.when(F.col("reason").isNull(), "events_by_user").otherwise("dead_letter")
        .alias("routed_to"),
        "reason")


def _add_user(messages):
    named = F.col("value").contains('"userId"')
    added = F.regexp_replace("value", r"^\{", '{"userId":"unknown",')
    return messages.withColumn("value", F.when(named, F.col("value")).otherwise(added))


@query
def dead_letter_replay(spark, sf):
    """Dead letters whose missing user is filled in, sent through again."""
    letters = routing.dead_letters(_parsed(spark, sf))

    again = routing.replay_dead_letters(letters, _add_user)
    return again.select(F.regexp_extract("raw", r'"id":"(\d+)"', 1).try_cast("bigint").alias("id"),
                        F.when(F.col("reason").isNull(), F.col("user_id")).alias("user_id"),
                        "reason")


@query
def keyed_publish(spark, sf):
    messages = enrich.keyed_messages(adapter.load_events(spark, sf))
    return messages.groupBy("key").agg(
        F.count("*").alias("n"),
        F.sum(F.get_json_object("value", "$.id").cast("bigint")).alias("sum_id"))


# -- folds ------------------------------------------------------------------

def _daily_baseline(spark, sf):
    counts = aggregate.user_counts(adapter.load_events(spark, sf), DAY)
    return baseline.ema_baseline(counts)


def _daily_anomalies(spark, sf):
    return baseline.anomalies(_daily_baseline(spark, sf))


@query
def ema_baseline(spark, sf):
    return baseline.with_z(_daily_baseline(spark, sf)).select(
        "user_id", "window_start", "count", "observations",
        "mean", "variance", "z_score")


@query
def anomalies_daily(spark, sf):
    return _daily_anomalies(spark, sf)


@query
def anomalies_low_threshold(spark, sf):
    """Threshold 2, which lets LOW severities through."""
    return baseline.anomalies(_daily_baseline(spark, sf), threshold=2.0)


def _throttled(spark, sf, bucket=SLOW, **options):
    requests = _requests(spark, sf).select("id", "timestamp", "api_key")
    return throttle.replay(requests, bucket, **options)


@query
def throttle_decisions(spark, sf):
    return _throttled(spark, sf).select("id", "api_key", "allowed", "tokens_left")


@query
def throttle_busy_keys(spark, sf):
    """The same decisions, with keys of more than 40 requests cut into stretches."""
    return (_throttled(spark, sf, busy_rows=40, stretch_rows=15)
            .select("id", "api_key", "allowed", "tokens_left"))


@query
def tokens_remaining(spark, sf):
    """Tokens of every key, and of one never seen, two hours after the last event."""
    decided = _throttled(spark, sf)
    states = throttle.final_states(decided, bucket=SLOW)
    requests = _requests(spark, sf)
    keys = (requests.select("api_key").distinct()
            .union(spark.range(1).select(F.lit("never-seen").alias("api_key"))))
    now = T.hours_before(toplists.newest(requests), -2)
    return throttle.tokens_remaining(keys, states, now, bucket=SLOW)


def _singles_too(requests):
    """Requests of which three in ten come without a batch."""
    return requests.withColumn("batch_id", F.when(F.col("id") % 1000 < 700, F.col("batch_id")))


@query
def ingest_calls(spark, sf):
    """Every call with its outcome; a batch takes one token."""
    return ingest.judge(_singles_too(_requests(spark, sf)), SLOW).select(
        "batch_id", "id", "api_key", "n_events", "outcome")


@query
def ingested_events(spark, sf):
    """Events of the accepted calls."""
    requests = _singles_too(_requests(spark, sf))
    return (ingest.accepted_events(requests, ingest.judge(requests, SLOW), replay=True)
            .select("id", "source_ip"))


# -- top lists --------------------------------------------------------------

_EVENT_COLUMNS = ["id", "user_id", "event_type", "timestamp", "payload"]


@query
def user_recent_events(spark, sf):
    events = adapter.load_events(spark, sf)
    return toplists.user_events(events, LOOKUP_USER, toplists.newest(events), hours=168,
                                limit=5000).select(_EVENT_COLUMNS)


@query
def user_recent_events_of_type(spark, sf):
    events = adapter.load_events(spark, sf)
    return toplists.user_events(events, LOOKUP_USER, toplists.newest(events), hours=168,
                                limit=3, event_type="click").select(_EVENT_COLUMNS)


@query
def user_day_buckets(spark, sf):
    events = enrich.with_buckets(adapter.load_events(spark, sf))
    days = ["2024-01-10", "2024-01-11", "2024-01-20"]
    return (toplists.day_buckets(events, LOOKUP_USER, days)
            .select("id", "user_id", "time_bucket", "timestamp"))


@query
def recent_events_per_user(spark, sf):
    events = adapter.load_events(spark, sf)
    return (toplists.events_per_user(events, toplists.newest(events), limit=2)
            .select("id", "user_id", "event_type", "timestamp", "rank"))


@query
def recent_anomalies(spark, sf):
    now = toplists.newest(adapter.load_events(spark, sf))
    return toplists.recent_anomalies(_daily_anomalies(spark, sf), now,
                                     hours=24, limit=3)


@query
def user_hour_anomalies(spark, sf):
    return toplists.user_anomalies(_daily_anomalies(spark, sf),
                                   ANOMALY_USER, ANOMALY_HOUR)


# -- upserts and retention --------------------------------------------------

def _written_twice(spark, sf):
    """Every event, and a later rewrite of each with another payload."""
    events = adapter.load_events(spark, sf).withColumn(
        "processed_at", F.col("timestamp") + F.make_dt_interval(secs=F.lit(1)))
    again = events.withColumns({
        "payload": F.concat(F.lit('{"v":'), F.col("id").cast("string"), F.lit("}")),
        "processed_at": F.col("processed_at") + F.make_dt_interval(secs=F.lit(60))})
    return events.unionByName(again)


@query
def dedup_event_key(spark, sf):
    return (upsert.upsert_events(_written_twice(spark, sf))
            .select("id", "user_id", "time_bucket", "timestamp", "payload"))


@query
def dedup_user_instant(spark, sf):
    """Times cut to the hour, so that events of one user and hour collide."""
    hourly = adapter.load_events(spark, sf).withColumn(
        "timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return upsert.upsert_instants(hourly).select("id", "user_id", "time_bucket", "timestamp")


@query
def retention_events(spark, sf):
    events = adapter.load_events(spark, sf)
    return upsert.retained(events, "timestamp", toplists.newest(events),
                           RETAIN_DAYS).select("id", "timestamp")


# -- metrics ----------------------------------------------------------------

def _outcomes(spark, sf):
    """What became of each request: checked, throttled, then processed."""
    checked = ingest.validate(ingest.with_client(_requests(spark, sf)))
    decided = throttle.replay(checked.where("is_valid").select("id", "timestamp", "api_key"),
                              SLOW)
    outcome = (F.when(~F.col("allowed"), "rate_limited")
               .when(F.col("id") % 101 == 0, "failed").otherwise("processed"))
    return (decided.select("id", "timestamp", outcome.alias("outcome"))
            .unionByName(checked.where("NOT is_valid")
                         .select("id", "timestamp", F.lit("invalid").alias("outcome"))))


@query
def outcome_totals(spark, sf):
    return metrics.with_status(metrics.outcome_totals(_outcomes(spark, sf)))


@query
def anomaly_totals(spark, sf):
    found = _daily_anomalies(spark, sf).agg(F.count("*").alias("anomalies"))
    return metrics.with_status(found)


@query
def ingest_rate_1m(spark, sf):
    return metrics.rates(adapter.load_events(spark, sf))


@query
def outcome_rate_1m(spark, sf):
    return metrics.rates(_outcomes(spark, sf), ["outcome"])


@query
def load_summary(spark, sf):
    return metrics.load_summary(_outcomes(spark, sf))


@query
def latency_quantiles_null_group(spark, sf):
    """As below, with a tenth of the events of no known type."""
    raw = adapter.raw_events(spark, sf).withColumn(
        "event_type", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))
    found = metrics.quantiles(raw, "value", "event_type")
    return found.withColumn("value", F.round("value", 6))


@query
def latency_quantiles(spark, sf):
    """The ``value`` column stands in for a latency, the event type for a timer."""
    raw = adapter.raw_events(spark, sf)
    found = metrics.quantiles(raw, "value", "event_type")
    return found.select("event_type", "quantile", F.round("value", 6).alias("value"))


@query
def latency_histogram(spark, sf):
    raw = adapter.raw_events(spark, sf)
    return metrics.histogram(raw, "value", 0.0, 100.0, 20, ["event_type"]).select(
        "event_type", F.col("bucket").cast("bigint").alias("bucket"), "n", "cumulative",
        F.round("upper", 6).alias("upper"))


@query
def pipeline_delay(spark, sf):
    """Processing times are set by rule: (id mod 997) ms after the event. Quantiles are
    found by passes, however few the rows."""
    events = adapter.load_events(spark, sf).withColumn(
        "processed_at", F.col("timestamp") + F.make_dt_interval(
            secs=((F.col("id") % 997) / 1000).cast("decimal(18,6)")))
    found = metrics.quantiles(metrics.processing_delay(events), "delay_ms", "event_type")
    return found.select("event_type", "quantile", F.round("delay_ms", 6).alias("delay_ms"))


@query
def stored_event_check(spark, sf):
    """How many events of each user the last day holds."""
    events = adapter.load_events(spark, sf)
    return (toplists.look_back(events, toplists.newest(events))
            .groupBy("user_id").agg(F.count("*").alias("stored")))


@query
def synthetic_events(spark, sf):
    """One generated request per event, drawn from the event's id."""
    numbers = adapter.raw_events(spark, sf).select(F.col("event_id").alias("id"))
    return synthetic.load_events(numbers)


@query
def sliding_rate_15s(spark, sf):
    return metrics.sliding_rates(adapter.load_events(spark, sf)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def sliding_rate_by_type(spark, sf):
    """Five minutes looked back on, every minute."""
    found = metrics.sliding_rates(adapter.load_events(spark, sf), ["event_type"], every=60, span=300)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def latency_summaries(spark, sf):
    """Quantiles from a stored table of hourly sketches: rows behind them, and whether each
    one's rank is within the documented bound of the exact one."""
    events = adapter.load_events(spark, sf).join(
        adapter.raw_events(spark, sf).select(F.col("event_id").alias("id"), "value"), "id")
    path = f"{workspace(spark, 'sketches')}/hourly"
    sketches.summaries(events, "value", ["event_type"], size="1 hour").write.parquet(path)
    found = sketches.quantiles(sketches.merged(spark.read.parquet(path), ["event_type"]), ["event_type"])
    checked = sketches.ranks(events, "value", found, ["event_type"])
    error, p = sketches.rank_error(), F.col("quantile")
    return found.join(checked, ["event_type", "quantile"]).select(
        "event_type", "n", "quantile", ((F.col("below") <= p + error) & (F.col("up_to") >= p - error)).alias("within_bound"))


# -- lookups on stored tables --------------------------------------------------
# Each first stores the events or anomalies of the whole table, then looks up.

def _stored_events(spark, sf, name):
    """The event table and the increments, in two batches; a third of the events is written twice."""
    tables = Tables(f"{workspace(spark, name)}/tables")
    events = adapter.load_events(spark, sf).withColumns({
        "id": F.col("id").cast("string"), "user_id": F.col("user_id").cast("string"),
        "processed_at": F.col("timestamp").cast("timestamp")})
    for batch, some in enumerate((events.where("cast(id as bigint) % 3 <> 0"), events.where("cast(id as bigint) % 3 <> 1"))):
        again = some.withColumn("processed_at", F.col("processed_at") + F.make_dt_interval(secs=F.lit(batch)))
        again = again.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        table.write_events(table.laid_out(again.select(*_STORED_COLUMNS)), tables, batch)
        fresh = again if not batch else again.where("cast(id as bigint) % 3 = 0")
        table.write_increments(aggregate.window_counts(fresh), tables, batch)
    return tables


_STORED_COLUMNS = ["id", "event_type", "user_id", "timestamp", "payload", "source_ip", "processed_at"]


def _as_loaded(found):
    return found.select(F.col("id").cast("bigint").alias("id"), F.col("user_id").cast("bigint").alias("user_id"),
                        "event_type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "payload")


@query
def stored_user_events(spark, sf):
    tables = _stored_events(spark, sf, "lookup-events")
    return _as_loaded(lookups.user_events(spark, tables, str(LOOKUP_USER), lookups.newest(spark, tables),
                                          hours=168, limit=5000))


@query
def stored_user_events_of_type(spark, sf):
    """Three rows: the buckets before the third are not opened."""
    tables = _stored_events(spark, sf, "lookup-type")
    return _as_loaded(lookups.user_events(spark, tables, str(LOOKUP_USER), lookups.newest(spark, tables),
                                          hours=168, limit=3, event_type="click"))


@query
def stored_counter(spark, sf):
    tables = _stored_events(spark, sf, "lookup-counter")
    now = lookups.newest(spark, tables)
    first = now - timedelta(hours=T.clamp(500, *toplists.EVENT_HOURS))
    return lookups.counter(spark, tables, str(LOOKUP_USER), "view", f"{first:%Y-%m-%d}", f"{now:%Y-%m-%d}").withColumn(
        "user_id", F.col("user_id").cast("bigint"))


@query
def stored_order(spark, sf):
    """Rows of each stored day that are out of order in their file: none."""
    return lookups.disorder(_stored_events(spark, sf, "lookup-order").read_stored(spark))


def _stored_anomalies(spark, sf, name):
    tables = Tables(f"{workspace(spark, name)}/tables")
    found = _daily_anomalies(spark, sf).withColumns({
        "user_id": F.col("user_id").cast("string"), "detected_at": F.col("detected_at").cast("timestamp")})
    table.write_anomalies(found, tables)
    return tables


@query
def stored_recent_anomalies(spark, sf):
    now = adapter.load_events(spark, sf).agg(F.max("timestamp")).first()[0]
    found = lookups.recent_anomalies(spark, _stored_anomalies(spark, sf, "lookup-recent"), now, hours=24, limit=3)
    return found.withColumns({"user_id": F.col("user_id").cast("bigint"),
                              "detected_at": F.col("detected_at").cast("timestamp_ntz")})


@query
def stored_user_hour_anomalies(spark, sf):
    tables = _stored_anomalies(spark, sf, "lookup-hour")
    return lookups.user_hour_anomalies(spark, tables, str(ANOMALY_USER), ANOMALY_HOUR).withColumns({
        "user_id": F.col("user_id").cast("bigint"), "detected_at": F.col("detected_at").cast("timestamp_ntz")})


# -- streams ------------------------------------------------------------------
# Each runs its stream to the end of the events file and returns the stored result.

FILES_PER_BATCH = 1000


def _streamed(spark, sf, name, max_files=None):
    """Raw event rows as a stream, and a folder for what the stream writes.

    Jobs that depend on time order read all files in one batch, as the files of a
    table are in no order; the others take ``max_files`` at a time.
    """
    stream = streams.file_events(spark, adapter.events_glob(sf), max_files)
    return stream, workspace(spark, name)


def _finish(started):
    started.awaitTermination()
    return started


def _stored(spark, sf, name, messages):
    raw, root = _streamed(spark, sf, name, FILES_PER_BATCH)
    tables = Tables(f"{root}/tables")
    _finish(jobs.process_events(messages(raw), tables, f"{root}/checkpoint", jobs.ONCE))
    return tables


@query
def stream_minute_counts(spark, sf):
    def messages(raw):
        return enrich.keyed_messages(adapter.as_events(raw))

    tables = _stored(spark, sf, "minute-counts", messages)
    increments = tables.read(spark, tables.increments, INCREMENTS_DDL)
    return (increments.groupBy("user_id", "event_type", "window_start", "window_end",
                               "window_minutes")
            .agg(F.sum("count").alias("count"))
            .withColumns({c: F.col(c).cast("timestamp_ntz")
                          for c in ("window_start", "window_end")}))


@query
def stream_event_tables(spark, sf):
    tables = _stored(spark, sf, "event-tables", adapter.as_raw_messages)
    events = tables.read_events(spark).select(
        F.col("id").cast("bigint").alias("id"), F.lit("events_by_user").alias("routed_to"),
        F.lit(None).cast("string").alias("reason"))
    letters = tables.read_dead_letters(spark).select(
        F.regexp_extract("raw", r'"id":"(\d+)"', 1).try_cast("bigint").alias("id"),
        F.lit("dead_letter").alias("routed_to"), "reason")
    return events.unionByName(letters)


@query
def stream_profiled_events(spark, sf):
    """Profiles looked up as the stream runs, read back from the stored payloads."""
    def known():
        return adapter.user_profiles(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))

    raw, root = _streamed(spark, sf, "profiled", FILES_PER_BATCH)
    tables = Tables(f"{root}/tables")
    _finish(jobs.process_events(adapter.as_raw_messages(raw), tables, f"{root}/checkpoint", jobs.ONCE,
                                user_profiles=known))
    return tables.read_events(spark).select(
        F.col("id").cast("bigint").alias("id"), "user_id",
        F.get_json_object("payload", "$._segment").alias("segment"),
        F.get_json_object("payload", "$._nation").alias("nation"),
        F.get_json_object("payload", "$._category").alias("category"))


@query
def stream_replayed_counters(spark, sf):
    """Dead letters of the stream replayed twice: what the first one repairs counts once."""
    tables = _stored(spark, sf, "replayed", adapter.as_raw_messages)
    for _ in range(2):
        replay.replay(spark, tables, _add_user)
    return tables.read_counters(spark)


@query
def stream_replayed_events(spark, sf):
    """Events stored after the replays, and the letters that still wait."""
    tables = _stored(spark, sf, "replayed-events", adapter.as_raw_messages)
    for _ in range(2):
        replay.replay(spark, tables, _add_user)
    events = tables.read_events(spark).groupBy().agg(F.count("*").alias("events"), F.countDistinct("id").alias("ids"))
    waiting = replay.waiting(spark, tables).groupBy("reason").agg(F.count("*").alias("n"))
    return (events.select(F.lit("stored").alias("state"), F.col("events").alias("n"))
            .unionByName(waiting.select(F.col("reason").alias("state"), "n")))


@query
def stream_daily_counters(spark, sf):
    return _stored(spark, sf, "counters", adapter.as_raw_messages).read_counters(spark)


def _in_turn(spark, sf, name, slices, start):
    """Feeds the events to a stream slice by slice: a slice arrives, the stream handles it
    in a micro-batch, stops, and goes on from its checkpoint when the next one is there.
    A slice comes in as many files of one size as tasks can run, so that all take part."""
    root, files = workspace(spark, name), spark.sparkContext.defaultParallelism
    for part in slices(adapter.raw_events(spark, sf)):
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
        _finish(start(streams.file_events(spark, f"{root}/in"), root))
    return root


@query
def stream_folded_counters(spark, sf):
    """Increments are folded and dropped between the slices; the last slice stays loose."""
    def start(raw, root):
        tables = Tables(f"{root}/tables")
        table.fold_increments(spark, tables)
        table.drop_folded(spark, tables)
        return jobs.process_events(adapter.as_raw_messages(raw), tables, f"{root}/checkpoint", jobs.ONCE)

    root = _in_turn(spark, sf, "folded", _mixed, start)
    return Tables(f"{root}/tables").read_counters(spark)


def _mixed(raw, n=3):
    """Slices that each hold events of all times."""
    return [raw.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i) for i in range(n)]


def _by_time(raw, n=3):
    """Slices of equal size, one after the other in time."""
    at = T.micros("ts")
    cuts = raw.select(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] or []
    return [raw.where(((at > low) if low is not None else F.lit(True)) & ((at <= high) if high is not None else F.lit(True)))
            for low, high in zip([None, *cuts], [*cuts, None])]


@query
def stream_anomalies(spark, sf):
    """Days arrive in three mixed slices, so most windows are late once or twice."""
    def start(raw, root):
        return stateful.watch(adapter.as_events(raw), Tables(f"{root}/tables"), f"{root}/checkpoint",
                              size=DAY, trigger=jobs.ONCE)

    root = _in_turn(spark, sf, "anomalies", _mixed, start)
    return (Tables(f"{root}/tables").read_anomalies(spark)
            .withColumns({"user_id": F.col("user_id").cast("bigint"),
                          "detected_at": F.col("detected_at").cast("timestamp_ntz")}))


def _bucket_stream(spark, sf, name):
    def start(raw, root):
        decided = stateful.bucket_decisions(adapter.as_requests(raw), SLOW)
        return (decided.writeStream.format("parquet").option("path", f"{root}/decisions")
                .option("checkpointLocation", f"{root}/checkpoint").trigger(**jobs.ONCE).start())

    return _in_turn(spark, sf, name, _by_time, start)


@query
def stream_bucket_decisions(spark, sf):
    """Buckets in the state store, handed from slice to slice."""
    return spark.read.parquet(f"{_bucket_stream(spark, sf, 'buckets')}/decisions")


@query
def stream_tokens_remaining(spark, sf):
    """As ``tokens_remaining``, from the states a stream left in its checkpoint."""
    root = _bucket_stream(spark, sf, "buckets-left")
    requests = _requests(spark, sf)
    keys = (requests.select("api_key").distinct()
            .union(spark.range(1).select(F.lit("never-seen").alias("api_key"))))
    now = T.hours_before(toplists.newest(requests), -2)
    return throttle.tokens_remaining(keys, stateful.bucket_states(spark, f"{root}/checkpoint"), now, bucket=SLOW)


@query
def stream_daily_rollup(spark, sf):
    """Days from minutes in one stream; days are given once they are over for an hour."""
    def start(raw, root):
        days = stateful.rolled_up(adapter.as_events(raw)).withColumn("user_id", F.col("user_id").cast("bigint"))
        return (days.writeStream.format("parquet").outputMode("append").option("path", f"{root}/days")
                .option("checkpointLocation", f"{root}/checkpoint").trigger(**jobs.ONCE).start())

    root = _in_turn(spark, sf, "rollup", _by_time, start)
    return spark.read.parquet(f"{root}/days").select(
        "user_id", "event_type", F.date_format("window_start", "yyyy-MM-dd").alias("time_bucket"),
        "event_count", "windows")


@query
def stream_live_totals(spark, sf):
    """Totals of three streams that run side by side, gathered from their micro-batches."""
    listener = totals.TotalsListener(spark, f"{workspace(spark, 'live-totals')}/totals")

    def start(raw, root):
        tables, requests = Tables(f"{root}/tables"), adapter.as_requests(raw)
        for running in (
                jobs.process_events(adapter.as_raw_messages(raw), tables, f"{root}/cp-events", jobs.ONCE),
                stateful.watch(adapter.as_events(raw), tables, f"{root}/cp-anomalies", size=DAY, trigger=jobs.ONCE),
                stateful.bucket_decisions(requests, SLOW).writeStream.format("parquet")
                .option("path", f"{root}/decisions").option("checkpointLocation", f"{root}/cp-buckets")
                .trigger(**jobs.ONCE).start()):
            if not listener.finished(running):
                raise TimeoutError("a stream's last report has not come")
        return running

    spark.streams.addListener(listener)
    try:
        _in_turn(spark, sf, "live", _by_time, start)
    finally:
        spark.streams.removeListener(listener)
    return totals.dashboard(spark, listener.path)


@query
def stream_throttle(spark, sf):
    """The batch throttle per slice, states handed on in tables; busy keys are split."""
    def start(raw, root):
        requests = adapter.as_requests(raw).select("id", "timestamp", "api_key")
        return jobs.throttle_stream(requests, root, f"{root}/checkpoint", SLOW, keep="30 days", trigger=jobs.ONCE)

    root = _in_turn(spark, sf, "throttle", _by_time, start)
    return (spark.read.parquet(f"{root}/decisions")
            .select("id", "api_key", "allowed", "tokens_left"))


@query
def stream_ingest(spark, sf):
    """Messages that the ingest job publishes."""
    raw, root = _streamed(spark, sf, "ingest")
    requests = _singles_too(adapter.as_requests(raw))
    _finish(jobs.ingest_stream(requests, root, f"{root}/checkpoint", SLOW, replay=True,
                               trigger=jobs.ONCE))
    return spark.read.parquet(f"{root}/messages").select(
        F.get_json_object("value", "$.id").cast("bigint").alias("id"), "key",
        F.get_json_object("value", "$.sourceIp").alias("source_ip"))


@query
def stream_without_repeats(spark, sf):
    """Every event sent twice, each kept once."""
    raw, root = _streamed(spark, sf, "repeats")
    doubled = adapter.as_events(raw).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = jobs.without_repeats(doubled, "30 days").select("id", "user_id", "event_type")
    _finish(kept.writeStream.format("parquet").option("path", f"{root}/kept")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(**jobs.ONCE).start())
    return spark.read.parquet(f"{root}/kept")
