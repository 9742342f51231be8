"""Latency summaries a minute that merge into any range: quantiles without the values.

A summary is a KLL sketch, whose size depends on ``k`` and hardly on the rows behind it.
Summaries of tasks, minutes, batches and groups merge without loss of guarantee, so a
table of them answers for any range and any grouping of what it was kept by. Ranks are
off by no more than ``rank_error(k)`` of all rows, with a confidence of 99 per cent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

K = 400     # about 1 per cent of the ranks, a few kilobytes a summary


def rank_error(k: int = K) -> float:
    """Documented bound of a sketch's normalised rank error, both sides together."""
    return 2.446 / k ** 0.9433


def summaries(values: DataFrame, value: str, by: Sequence[str] = (), *, at: str = "timestamp",
              size: str = "1 minute", k: int = K) -> DataFrame:
    """``(*by, window_start, n, least, most, sketch)`` of each window.

    Null and NaN values are not counted; a row without a time is left out. A null group is a
    group. Sketches are made by a partial aggregate, so a group of any size sends one a task.
    """
    v = F.col(value).cast("double")
    good = values.where(v.isNotNull() & ~F.isnan(v))
    return (good.groupBy(*by, F.window(at, size)["start"].alias("window_start"))
            .agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                 F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")))


def merged(kept: DataFrame, by: Sequence[str] = (), *, k: int = K) -> DataFrame:
    """Summaries of any windows and groups as one per ``by``."""
    return kept.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles(kept: DataFrame, by: Sequence[str] = (), ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(*by, n, quantile, value)`` of merged summaries; the ends are exact."""
    def at(p: float):
        return (F.col("least") if p <= 0 else F.col("most") if p >= 1
                else F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))

    each = F.array(*(F.struct(F.lit(float(p)).alias("quantile"), at(p).alias("value")) for p in ps))
    return kept.where("n > 0").select(*by, "n", F.inline(each))


def ranks(values: DataFrame, value: str, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds to ``found`` the shares of the values below it and up to it: the exact check.

    ``found`` has a row per group and quantile, so each value meets a handful of numbers.
    """
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    named = found.withColumnsRenamed({c: f"_{c}" for c in by}).withColumnRenamed("value", "_value").drop("n")
    counted = (values.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
               .groupBy(*by, "_x").agg(F.count("*").alias("_n")).join(named, same))
    return counted.groupBy(*by, "quantile", F.col("_value").alias("value")).agg(
        (F.sum(F.when(F.col("_x") < F.col("_value"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("below"),
        (F.sum(F.when(F.col("_x") <= F.col("_value"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("up_to"))
