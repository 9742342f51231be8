"""Batches that hold their requests as an array."""

from helpers import rows
from pyspark.sql import functions as F

from tallybrook.operators import ingest

DDL = "batch_id int, note string, events array<struct<id:bigint,event_type:string,user_id:string,payload:string>>"
GOOD = (1, "click", "u", "{}")


def verdicts(spark, *arrays):
    df = spark.createDataFrame([(i, "n", a) for i, a in enumerate(arrays)], DDL)
    return ingest.array_verdicts(df).orderBy("batch_id").collect()


def test_every_batch_has_a_verdict(spark):
    got = verdicts(spark, [], None, [GOOD], [GOOD] * 100, [GOOD] * 101)
    assert [(r.n_events, r.n_invalid, r.accepted, r.n_accepted, r.messages) for r in got] == [
        (0, 0, False, 0, ["events: events list must not be empty"]),
        (0, 0, False, 0, ["events: events list must not be empty"]),
        (1, 0, True, 1, []), (100, 0, True, 100, []),
        (101, 0, False, 0, ["events: batch size must not exceed 100 events"])]
    assert got[0].note == "n" and "events" not in got[0].asDict()


def test_messages_name_the_element(spark):
    got = verdicts(spark, [GOOD, (2, " ", "u" * 101, None), None, GOOD], [GOOD] * 101 + [(3, None, "u", "{}")])
    assert got[0].messages == [
        "events[1].eventType: eventType is required", "events[1].userId: userId must be under 100 characters",
        "events[1].payload: payload is required", "events[2]: event is required"]
    assert got[0].n_invalid == 2 and not got[0].accepted
    assert got[1].messages == ["events: batch size must not exceed 100 events", "events[101].eventType: eventType is required"]


def test_accepted_batches_are_those_that_flatten(spark):
    arrays = [[GOOD], [GOOD, None], None, [], [GOOD] * 100, [GOOD] * 101, [(1, "x" * 51, "u", "{}")]]
    df = spark.createDataFrame([(i, "n", a) for i, a in enumerate(arrays)], DDL)
    flat = ingest.flatten_batches(df).groupBy("batch_id").agg(F.count("*").alias("n"))
    assert rows(flat) == rows(ingest.array_verdicts(df).where("accepted"), "batch_id", "n_accepted") == [(0, 1), (4, 100)]


def test_verdicts_need_no_shuffle(spark):
    df = spark.createDataFrame([(0, "n", [GOOD])], DDL)
    assert "Exchange" not in ingest.array_verdicts(df)._jdf.queryExecution().executedPlan().toString()


def test_requests_without_a_batch_have_no_batch_verdict(spark):
    df = spark.createDataFrame([(None, "click", "u", "{}"), (1, "click", "u", "{}")],
                               "batch_id int, event_type string, user_id string, payload string")
    assert rows(ingest.batch_verdicts(df), "batch_id", "n_events", "accepted") == [(1, 1, True)]
