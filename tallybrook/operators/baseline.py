"""Moving baseline per user, z-scores and anomalies.

The baseline is a fold in time order. It runs on window counts, not on events: a
user has at most one row per window, so the longest fold is bounded by the time
span (about a million 30-second windows a year) and not by the user's share of
the events. Rows reach the fold sorted and in Arrow batches; a task keeps one
user's three numbers and never a whole group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalars
from ..functions.arrow import runs

# Smoothing, threshold, warm-up and the name of the metric.
ALPHA = 0.1
THRESHOLD = 3.0
MIN_OBSERVATIONS = 10
METRIC = "event_rate"

_NEW = (0.0, 0.0, 0)
_STATE = [T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType()),
          T.StructField("observations", T.LongType())]


def ema_run(xs: list[float], mean: float, variance: float, n: int,
            alpha: float) -> tuple[list[tuple[float, float, int]], tuple[float, float, int]]:
    """The baseline each observation meets, and the one left after the last."""
    met, keep = [], 1 - alpha
    for x in xs:
        met.append((mean, variance, n))
        if n:
            gap = x - mean
            mean = keep * mean + alpha * x
            variance = keep * variance + alpha * gap * gap
        else:
            mean, variance = x, 0.0
        n += 1
    return met, (mean, variance, n)


def ema_baseline(counts: DataFrame, *, key: str = "user_id", at: str = "window_start",
                 value: str = "count", alpha: float = ALPHA) -> DataFrame:
    """Adds the baseline each row meets: ``mean``, ``variance``, ``observations``.

    These are the values *before* the row itself is taken in.
    """
    ordered = counts.repartition(key).sortWithinPartitions(key, at)
    k, v = counts.columns.index(key), counts.columns.index(value)
    names = [*counts.columns, *(f.name for f in _STATE)]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, _NEW
        for batch in batches:
            xs, met = batch.column(v).cast(pa.float64()).to_pylist(), []
            for a, z in runs(batch, k):
                owner = (batch.column(k)[a].as_py(),)
                if owner != current:
                    current, state = owner, _NEW
                seen, state = ema_run(xs[a:z], *state, alpha)
                met += seen
            added = zip(zip(*met), (pa.float64(), pa.float64(), pa.int64()))
            if met:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(x, kind) for x, kind in added)], names=names)

    return ordered.mapInArrow(fold, T.StructType([*counts.schema.fields, *_STATE]))


def z_score(value: str = "count") -> Column:
    """Distance from the baseline in deviations; the deviation is at least 1."""
    return (F.col(value) - F.col("mean")) / F.greatest(F.sqrt("variance"), F.lit(1.0))


def with_z(baseline: DataFrame, value: str = "count") -> DataFrame:
    return baseline.withColumn("z_score", z_score(value))


def anomalies(baseline: DataFrame, *, threshold: float = THRESHOLD,
              min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Rows of the anomaly table; ``detected_at`` is the end of the window."""
    return anomaly_rows(with_z(baseline).where(
        (F.col("observations") >= min_observations) & (F.abs("z_score") > threshold)))


def anomaly_rows(found: DataFrame, *extra: str) -> DataFrame:
    """Windows that have a ``z_score`` in the columns of the anomaly table."""
    return found.select(
        F.date_format("window_end", "yyyy-MM-dd-HH").alias("time_bucket"),
        F.col("window_end").alias("detected_at"),
        F.concat_ws(":", F.lit(METRIC), F.col("user_id").cast("string"),
                    F.date_format("window_end", "yyyyMMddHHmmss")).alias("anomaly_id"),
        "user_id",
        F.lit(METRIC).alias("metric"),
        F.col("count").cast("double").alias("observed_value"),
        F.col("mean").alias("expected_value"),
        "z_score",
        scalars.severity(F.abs("z_score")).alias("severity"),
        *extra,
    )
