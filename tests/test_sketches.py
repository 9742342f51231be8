"""Mergeable latency summaries against exact ranks."""

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import sketches


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(60_000).select(
        F.when(F.col("id") % 7 < 5, F.concat(F.lit("g"), F.col("id") % 2)).alias("kind"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan"))
        .otherwise(F.pow((F.col("id") * 7919 % 60_000) / 1000, 3)).alias("ms"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 7200).alias("timestamp"))


@pytest.mark.parametrize("k", [100, 400])
def test_ranks_are_within_the_bound(spark, values, k):
    kept = sketches.summaries(values, "ms", ["kind"], k=k)
    found = sketches.quantiles(sketches.merged(kept, ["kind"], k=k), ["kind"], [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])
    checked = sketches.ranks(values, "ms", found, ["kind"]).collect()
    assert len(checked) == 18       # three groups, the null one among them
    for r in checked:
        assert r.below - sketches.rank_error(k) <= r.quantile <= r.up_to + sketches.rank_error(k)
        if r.quantile in (0, 1):
            assert (r.below == 0) if r.quantile == 0 else (r.up_to == 1)


def test_counts_and_merging_in_steps(spark, values):
    good = values.where("ms is not null and not isnan(ms)").count()
    kept = sketches.summaries(values, "ms", ["kind"])
    assert kept.count() == 3 * 120 and kept.agg(F.sum("n")).first()[0] == good
    hours = sketches.merged(kept.withColumn("hour", F.date_trunc("hour", "window_start")), ["hour"])
    both = sketches.merged(hours)
    assert both.first().n == good
    r = sketches.ranks(values.withColumn("all", F.lit(1)), "ms",
                       sketches.quantiles(both.withColumn("all", F.lit(1)), ["all"]), ["all"]).collect()
    assert all(x.below - sketches.rank_error() <= x.quantile <= x.up_to + sketches.rank_error() for x in r)


def test_size_does_not_follow_the_rows(spark):
    def size(n):
        rows = spark.range(n).select((F.col("id") * 31 % 100_003).alias("v"), F.timestamp_seconds(F.lit(0)).alias("timestamp"))
        return sketches.summaries(rows, "v").select(F.length("sketch")).first()[0]
    assert size(1_000_000) < 1.5 * size(10_000) < 40_000


def test_nothing_and_nulls_only(spark, values):
    none = sketches.summaries(values.where("false"), "ms", ["kind"])
    assert none.count() == 0 and sketches.quantiles(sketches.merged(none, ["kind"]), ["kind"]).count() == 0
    assert sketches.summaries(values.where("ms is null"), "ms").count() == 0
