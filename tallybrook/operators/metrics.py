"""Totals, rates, latency quantiles and histograms as table queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars, time as T

# Quantiles reported, and (warn, alarm, warn colour) of each total.
QUANTILES = (0.5, 0.95, 0.99)
THRESHOLDS = {
    "ingested": (10000, 100000, "yellow"),
    "failed": (1, 10, "yellow"),
    "anomalies": (1, 5, "orange"),
}


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row of totals from rows that carry an ``outcome``."""
    def n(*names):
        return F.count_if(F.col("outcome").isin(*names))

    return outcomes.agg(
        n("processed", "failed").alias("ingested"),
        n("processed").alias("processed"),
        n("failed").alias("failed"),
        n("rate_limited").alias("rate_limited"),
        n("invalid").alias("invalid"),
    )


def with_status(totals: DataFrame) -> DataFrame:
    """Adds a ``<total>_status`` for each total that has thresholds."""
    for name, (warn, alarm, colour) in THRESHOLDS.items():
        if name in totals.columns:
            totals = totals.withColumn(f"{name}_status",
                                       scalars.threshold_status(name, warn, alarm, colour))
    return totals


def rates(events: DataFrame, by: Sequence[str] = (), size: str = "1 minute",
          seconds: float = 60.0) -> DataFrame:
    """Events per second, averaged over each window."""
    return (events.groupBy(F.window("timestamp", size)["start"].alias("window_start"), *by)
            .agg(F.count("*").alias("n"))
            .select("window_start", *by, "n",
                    (F.col("n") / F.lit(seconds)).alias("per_second")))


def sliding_rates(events: DataFrame, by: Sequence[str] = (), *, every: int = 15, span: int = 60) -> DataFrame:
    """Events per second over the last ``span`` seconds, every ``every`` seconds.

    ``at`` is a multiple of ``every``; the events of ``[at - span, at)`` count. A time is left
    out when there were none. Events are first counted in slots of ``every`` seconds, then
    each slot adds to the ``span / every`` times that look back on it: both are partial
    aggregates, so the input is read once and no key's times pass through one task.
    """
    if span % every:
        raise ValueError("the span must be a multiple of the step")
    step = every * 1_000_000
    slots = (events.where("timestamp is not null")
             .groupBy(F.floor(T.micros("timestamp") / step).alias("_slot"), *by).agg(F.count("*").alias("_n")))
    seen = slots.select(*by, "_n", F.explode(F.sequence(F.col("_slot") + 1, F.col("_slot") + span // every)).alias("_at"))
    return (seen.groupBy("_at", *by).agg(F.sum("_n").alias("n"))
            .select(F.timestamp_micros(F.col("_at") * step).alias("at"), *by, "n",
                    (F.col("n") / F.lit(float(span))).alias("per_second")))


def histogram(values: DataFrame, value: str, low: float, high: float, buckets: int,
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bucket, with the running total up to each bucket.

    Bucket 0 lies below ``low``, bucket ``buckets + 1`` from ``high`` on. The running
    total sees bucket counts only.
    """
    counts = (values.where(F.col(value).isNotNull())
              .groupBy(*by, F.width_bucket(value, F.lit(float(low)), F.lit(float(high)),
                                           F.lit(buckets)).alias("bucket"))
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy(*by).orderBy("bucket")
    upper = F.lit(low) + F.col("bucket") * F.lit((high - low) / buckets)
    return (counts.withColumn("cumulative", F.sum("n").over(w))
            .withColumn("upper", F.when(F.col("bucket") <= buckets, upper)))


def quantiles(values: DataFrame, value: str, by: str,
              probs: Sequence[float] = QUANTILES, passes: int = 2,
              slots: int = 65536) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, with bounded state.

    A plain percentile keeps every distinct value of a group in one task. Here a first
    pass counts the values of a group by sign and power of two, which gives the power that
    holds each wanted rank. Each further pass cuts those ranges into ``slots`` equal slots
    and goes on with the ones that hold the ranks. Of the 2**52 doubles within a power, a
    slot after two passes spans 2**20; the distinct values left in it are ranked. Every
    pass is a map-side hash aggregation over one scan, the same for any number of rows.

    Null values are left out, a null group is a group. Infinite values and NaN have ranks
    like others: -Infinity, finite values, Infinity, NaN.
    """
    rows = values.where(F.col(value).isNotNull()).select(
        F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    n = F.col("n")

    def wanted(p: float) -> list[Column]:
        spot = F.lit(float(p)) * (n - 1)
        part = spot - F.floor(spot)
        return [F.struct(F.lit(float(p)).alias("p"), part.alias("part"), rank.alias("rank"))
                for rank in (F.floor(spot), F.ceil(spot))]

    wants = F.array_distinct(F.array(*[w for p in probs for w in wanted(p)]))
    ranges = _holding(_slot_counts(rows, ["g"], _power())
                      .withColumn("n", F.sum("c").over(Window.partitionBy("g")))
                      .withColumn("want", F.explode(wants))
                      .select("g", "want.*", "c", "upto", "slot_low", "slot_high"))
    keys = ["g", "p", "part", "rank", "low", "high"]
    for i in range(passes + 1):
        spots = ranges.withColumnRenamed("g", "h")
        inside = (rows.join(spots, F.col("g").eqNullSafe(F.col("h")))
                  .where(F.col("v").between(F.col("low"), F.col("high"))))
        slot = _slot(slots) if i < passes else F.col("v")
        ranges = _holding(_slot_counts(inside, keys, slot))
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return (ranges.groupBy("g", "p", "part").agg(F.min("low").alias("a"), F.max("low").alias("b"))
            .select(F.col("g").alias(by), F.col("p").alias("quantile"),
                    F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a"))
                    .otherwise(between).alias(value)))


def _power() -> Column:
    """Sign and power of two of a value, as a number that grows with the value."""
    v = F.col("v")
    size = F.floor(F.log2(F.abs(v))) + 1100
    endless = F.abs(v) == float("inf")
    return F.when(F.isnan(v), 5000).when(endless, F.signum(v).cast("bigint") * 4000).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _slot(slots: int) -> Column:
    width = F.col("high") - F.col("low")
    at = F.floor((F.col("v") - F.col("low")) / width * slots)
    return F.when(F.col("high") > F.col("low"), F.least(at, F.lit(slots - 1))).otherwise(F.lit(0))


def _slot_counts(rows: DataFrame, keys: list[str], slot: Column) -> DataFrame:
    """Values per key and slot, with the running total up to the slot."""
    counts = (rows.groupBy(*keys, slot.alias("slot"))
              .agg(F.count("*").alias("c"), F.min("v").alias("slot_low"),
                   F.max("v").alias("slot_high")))
    w = Window.partitionBy(*keys).orderBy("slot")
    return counts.withColumn("upto", F.sum("c").over(w))


def _holding(counts: DataFrame) -> DataFrame:
    """The slot that holds each wanted rank, as the next range; ranks count from there."""
    before = F.col("upto") - F.col("c")
    return (counts.where((F.col("rank") >= before) & (F.col("rank") < F.col("upto")))
            .select("g", "p", "part", (F.col("rank") - before).alias("rank"),
                    F.col("slot_low").alias("low"), F.col("slot_high").alias("high")))


def processing_delay(events: DataFrame) -> DataFrame:
    """Adds ``delay_ms``: from the event's time to the end of its processing."""
    return events.withColumn("delay_ms", F.timestamp_diff(
        "MILLISECOND", F.col("timestamp").cast("timestamp"),
        F.col("processed_at").cast("timestamp")))


def load_summary(outcomes: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Requests per outcome and the overall throughput over the time they span.

    The throughput is null if all of them share one instant.
    """
    w = Window.partitionBy()    # over one row per outcome
    per = (outcomes.groupBy("outcome")
           .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")))
    elapsed = F.timestamp_diff("MILLISECOND", F.min("first").over(w), F.max("last").over(w))
    return per.select("outcome", "n",
                      F.floor(F.try_divide(F.sum("n").over(w) * 1000000, elapsed)).alias("per_1000_sec"))
