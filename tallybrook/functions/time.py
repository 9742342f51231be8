"""Buckets, windows and parameter clamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_bucket(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_bucket(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HH")


def window_start(ts: str | Column, seconds: int = 60) -> Column:
    """Start of the tumbling window holding ``ts``, in the type of ``ts``.

    For projections: a row without a time stays, with a null start. (``F.window`` would
    filter it out.)
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    past = F.pmod(micros(ts), F.lit(seconds * 1_000_000))
    return ts - F.make_dt_interval(secs=(past / 1_000_000).cast("decimal(18,6)"))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, for zoned and zone-less timestamps alike."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str)
                         else ts.cast("timestamp"))


def hours_before(anchor: Column, hours: int) -> Column:
    return anchor - F.make_dt_interval(hours=F.lit(hours))


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A query parameter forced into ``low..high``; ``default`` when missing."""
    return max(low, min(high, default if value is None else value))


def clamp_column(value: str | Column, low: int, high: int, default: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))
