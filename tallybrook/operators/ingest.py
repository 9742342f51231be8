"""Request validation, batches and the ingest stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars
from ..functions.bucket import TokenBucket
from . import throttle

# Events in a batch, messages about its size, key of callers without one.
MAX_BATCH = 100
NO_EVENTS = "events list must not be empty"
TOO_LARGE = "batch size must not exceed 100 events"
ANONYMOUS = "anonymous"

MAX_CROWDED = 10_000


def validate(requests: DataFrame) -> DataFrame:
    """Adds ``violations`` (array of messages) and ``is_valid``."""
    return (requests.withColumn("violations", scalars.violations())
            .withColumn("is_valid", scalars.is_valid()))


def batch_verdicts(requests: DataFrame, key: str = "batch_id") -> DataFrame:
    """One row per batch: a single bad request, or a wrong size, rejects all of it.

    Partial aggregation keeps one row per batch and map task, so an oversized
    batch costs no more to shuffle than a small one. Requests without a batch have no
    verdict here (``calls`` takes them one by one).
    """
    n, bad = F.col("n_events"), F.col("n_invalid")
    return (
        requests.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count("*").alias("n_events"),
             F.count_if(~scalars.is_valid()).alias("n_invalid"))
        .withColumn("accepted", (n >= 1) & (n <= MAX_BATCH) & (bad == 0))
        .withColumn("n_accepted", F.when(F.col("accepted"), n).otherwise(F.lit(0)))
        .withColumn("reason",
                    F.when(n > MAX_BATCH, TOO_LARGE)
                    .when(bad > 0, "invalid event"))
    )


def accepted_from_batches(requests: DataFrame, key: str = "batch_id") -> DataFrame:
    """The requests of accepted batches."""
    verdicts = batch_verdicts(requests, key)
    return _of_batches(requests, verdicts, verdicts.where("accepted"), key)


def _of_batches(requests: DataFrame, sized: DataFrame, passed: DataFrame, key: str) -> DataFrame:
    """The requests of ``passed`` batches, which hold 100 at most.

    The most crowded of the ``sized`` batches are filtered out before the join: at most
    ``MAX_CROWDED`` of them, so they can be broadcast, and any batch that is left has
    at most 1 / MAX_CROWDED of the requests.
    """
    crowded = (sized.orderBy(F.col("n_events").desc(), key).limit(MAX_CROWDED)
               .where(F.col("n_events") > MAX_BATCH).select(key))
    return (requests.join(F.broadcast(crowded), key, "left_anti")
            .join(passed.select(key), key, "left_semi"))


def calls(requests: DataFrame, key: str = "batch_id") -> DataFrame:
    """One row per call: a request without a batch, or a batch as a whole.

    ``is_valid`` tells whether the call passes validation. A batch has the id, api key,
    address and time of its first request.
    """
    named = requests.withColumn("is_valid", scalars.is_valid())
    own = ["id", "timestamp", "api_key", "source_ip"]
    alone = named.where(F.col(key).isNull()).select(
        key, *own, F.lit(1).cast("bigint").alias("n_events"), "is_valid")
    first = F.min(F.struct(F.col("timestamp").isNull().alias("late"), "timestamp", "id",
                           "api_key", "source_ip"))
    n = F.col("n_events")
    grouped = (named.where(F.col(key).isNotNull()).groupBy(key)
               .agg(first.alias("first"), F.count("*").alias("n_events"),
                    F.count_if(~F.col("is_valid")).alias("n_invalid"))
               .select(key, *(F.col(f"first.{c}").alias(c) for c in own), n,
                       ((n <= MAX_BATCH) & (F.col("n_invalid") == 0)).alias("is_valid")))
    return alone.unionByName(grouped)


def judge(requests: DataFrame, bucket: TokenBucket = TokenBucket(), *,
          key: str = "batch_id", **options) -> DataFrame:
    """Adds the ``outcome`` of each call: accepted, rate_limited or invalid.

    A call that passes validation takes one token of its api key, a batch as well. Calls
    without a time meet no throttle. ``options`` are those of ``throttle.replay``.
    """
    each = calls(with_client(requests), key)
    tried = throttle.replay(each.where("is_valid"), bucket, **options)
    refused = each.where(~F.col("is_valid")).withColumn("outcome", F.lit("invalid"))
    outcome = F.when(~F.col("allowed"), "rate_limited").otherwise("accepted")
    return (tried.withColumn("outcome", outcome)
            .unionByName(refused, allowMissingColumns=True).drop("is_valid"))


def accepted_events(requests: DataFrame, judged: DataFrame, key: str = "batch_id",
                    replay: bool = False) -> DataFrame:
    """Stamped events of the accepted calls, as ``judge`` found them.

    Single requests are told apart by their ids, which must not be null.
    """
    passed = judged.where("outcome = 'accepted'")
    named, single = with_client(requests), F.col(key).isNull()
    alone = named.where(single).join(passed.where(single).select("id"), "id", "left_semi")
    grouped = _of_batches(named.where(~single), judged.where(~single), passed.where(~single), key)
    return stamp(alone.unionByName(grouped), replay)


def array_verdicts(batches: DataFrame, events: str = "events") -> DataFrame:
    """A verdict for every batch row that holds an array of requests, rejected ones too.

    Adds ``n_events``, ``n_invalid``, ``messages``, ``accepted`` and ``n_accepted``. Messages
    tell about the array first, then about its elements in order, as in
    ``events[2].userId: userId is required``. A null array is an empty one; a null element is
    invalid. A batch is accepted as a whole when there is no message. All is read off the
    row itself, so nothing is shuffled; the array is dropped.
    """
    def told(e: Column, i: Column) -> Column:
        at = F.concat(F.lit("events["), i.cast("string"), F.lit("]"))
        own = scalars.violations(e["event_type"], e["user_id"], e["payload"], F.concat(at, F.lit(".")))
        return F.when(e.isNull(), F.array(F.concat(at, F.lit(": event is required")))).otherwise(own)

    n = F.coalesce(F.size(F.col(events)), F.lit(0)).cast("bigint")
    size = F.when(n < 1, f"events: {NO_EVENTS}").when(n > MAX_BATCH, f"events: {TOO_LARGE}")
    each = F.coalesce(F.transform(events, told), F.array().cast("array<array<string>>"))
    return (batches.withColumn("n_events", F.greatest(n, F.lit(0).cast("bigint")))
            .withColumn("_each", each)
            .withColumn("n_invalid", F.size(F.filter("_each", lambda m: F.size(m) > 0)).cast("bigint"))
            .withColumn("messages", F.concat(F.array_compact(F.array(size)), F.flatten("_each")))
            .withColumn("accepted", F.size("messages") == 0)
            .withColumn("n_accepted", F.when(F.col("accepted"), F.col("n_events")).otherwise(F.lit(0)))
            .drop("_each", events))


def flatten_batches(batches: DataFrame, events: str = "events") -> DataFrame:
    """Batch rows holding an array of requests -> one row per accepted request.

    Needs no shuffle: size and validity are read off the array itself.
    """
    def valid(e):
        return (scalars.not_blank(e["event_type"])
                & (F.char_length(e["event_type"]) <= scalars.MAX_EVENT_TYPE)
                & scalars.not_blank(e["user_id"])
                & (F.char_length(e["user_id"]) <= scalars.MAX_USER_ID)
                & e["payload"].isNotNull())

    others = [c for c in batches.columns if c != events]
    return (batches
            .where(F.size(events).between(1, MAX_BATCH) & F.forall(events, valid))
            .select(*others, F.posexplode(events).alias("position", "event"))
            .select(*others, "position", "event.*"))


def with_client(requests: DataFrame) -> DataFrame:
    """Adds ``source_ip`` and fills in the api key of anonymous callers."""
    return (requests
            .withColumn("source_ip", scalars.client_ip("x_forwarded_for", "remote_addr"))
            .withColumn("api_key", F.coalesce("api_key", F.lit(ANONYMOUS))))


def stamp(requests: DataFrame, replay: bool = False) -> DataFrame:
    """Requests -> events. A replay keeps the ids and times it is given."""
    return requests.select(
        (F.col("id") if replay else F.uuid()).alias("id"),
        "event_type",
        "user_id",
        (F.col("timestamp") if replay else F.current_timestamp()).alias("timestamp"),
        "payload",
        "source_ip",
        F.lit(None).cast("timestamp").alias("processed_at"),
    )
