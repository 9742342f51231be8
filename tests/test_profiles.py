"""Lookups of user profiles."""

import random

import pytest
from helpers import rows

from tallybrook.operators import profiles
from tallybrook.plans import catalog


def frames(spark, n=400):
    rng = random.Random(5)
    events = [(i, None if i % 17 == 0 else 7 if i % 3 == 0 else rng.randrange(60), f"t{i % 4}") for i in range(n)]
    known = [(u, f"s{u % 3}", None if u % 5 == 0 else u) for u in range(40)] + [(3, "zz", 1), (3, "s0", 9), (None, "none", 1)]
    return (spark.createDataFrame(events, "id bigint, user_id bigint, event_type string"), events,
            spark.createDataFrame(known, "user_id bigint, segment string, level int"))


def plain(events):
    own = {u: (f"s{u % 3}", None if u % 5 == 0 else u) for u in range(40)}
    own[3] = ("s0", 3)
    return sorted([(i, u, t, *own.get(u, (None, None))) for i, u, t in events], key=str)


@pytest.mark.parametrize("busy", [0, 1, 5, 1000])
@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_every_event_once_with_its_profile(spark, busy, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        events, listed, known = frames(spark)
        got = profiles.with_profiles(events, known, busy_users=busy)
        assert got.columns == ["id", "user_id", "event_type", "segment", "level"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == plain(listed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_sides_repeated_events_and_clashing_names(spark):
    events, _, known = frames(spark, 20)
    assert profiles.with_profiles(events.limit(0), known).count() == 0
    assert profiles.with_profiles(events.union(events), known).count() == 40
    none = profiles.with_profiles(events, known.limit(0))
    assert none.count() == 20 and none.where("segment IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="event_type"):
        profiles.with_profiles(events, known.withColumnRenamed("segment", "event_type"))


def test_large_profiles_are_shuffled_and_only_busy_users_broadcast(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = catalog.QUERIES["profiled_events"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "TakeOrderedAndProject" in text
        assert text.count("BroadcastHashJoin") >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_rows_agree_with_the_batch(spark, sf):
    stored = rows(catalog.QUERIES["stream_profiled_events"](spark, sf), "id", "segment", "nation")
    batch = {r.id: (r.id, r.segment, r.nation) for r in catalog.QUERIES["profiled_events"](spark, sf).collect()}
    assert stored and all(batch[r[0]] == r for r in stored)
