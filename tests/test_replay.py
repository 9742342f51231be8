"""The dead-letter loop: repaired letters reach the tables once, whatever fails on the way."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.operators import aggregate, enrich, routing
from tallybrook.session import configure
from tallybrook.sources import adapter, replay, tables as stored
from tallybrook.sources.tables import Tables


def add_user(messages):
    return messages.withColumn("value", F.when(F.col("value").contains('"userId"'), F.col("value")).otherwise(
        F.regexp_replace("value", r"^\{", '{"userId":"unknown",')))


@pytest.fixture
def tables(spark, sf, tmp_path):
    configure(spark)
    parsed = routing.parse_messages(adapter.as_raw_messages(adapter.raw_events(spark, sf)))
    made, good = Tables(str(tmp_path)), routing.good(parsed)
    stored.write_events(enrich.enrich(stored.laid_out(good)), made, 0)
    stored.write_increments(aggregate.window_counts(good), made, 0)
    letters = routing.dead_letters(parsed)
    stored.write_dead_letters(letters.unionByName(letters.where("reason = 'null_user_id'")), made, 0)
    return made


def state(spark, tables):
    return (tables.read_events(spark).count(), tables.read_counters(spark).agg(F.sum("event_count")).first()[0],
            replay.waiting(spark, tables).count())


def test_a_second_replay_changes_nothing(spark, tables):
    events, counted, letters = state(spark, tables)
    fixed = replay.waiting(spark, tables).where("reason = 'null_user_id'").count()
    assert fixed > 0 and replay.replay(spark, tables, add_user) == 0
    once = state(spark, tables)
    assert once[0] > events and once[0] - events == once[1] - counted == letters - once[2]
    assert replay.replay(spark, tables, add_user) == 1
    assert state(spark, tables) == once
    assert rows(tables.read_events(spark).where("user_id = 'unknown'").select(F.count("*"))) == [(once[0] - events,)]


def test_a_lost_replay_is_done_again(spark, tables, monkeypatch):
    before, write = state(spark, tables), stored.write_increments

    def lost(increments, into, batch_id):
        write(increments, into, batch_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(stored, "write_increments", lost)
    with pytest.raises(RuntimeError):
        replay.replay(spark, tables, add_user)
    monkeypatch.setattr(stored, "write_increments", write)
    assert replay.next_number(spark, tables) == 0 and replay.waiting(spark, tables).count() == before[2]
    assert replay.replay(spark, tables, add_user) == 0
    after = state(spark, tables)
    assert after[0] - before[0] == after[1] - before[1] == before[2] - after[2] > 0


def test_what_stays_broken_waits_for_another_repair(spark, tables):
    assert replay.replay(spark, tables) == 0
    left = replay.waiting(spark, tables).where("reason = 'null_event_type'").count()

    def add_type(messages):
        return add_user(messages).withColumn("value", F.when(
            F.col("value").contains('"eventType":null') | ~F.col("value").contains('"eventType"'),
            F.regexp_replace(F.regexp_replace("value", '"eventType":null,?', ""), r"^\{", '{"eventType":"other",')).otherwise(F.col("value")))

    assert left > 0 and replay.replay(spark, tables, add_type) == 1
    assert replay.waiting(spark, tables).where("reason = 'null_event_type'").count() == 0
    assert tables.read_events(spark).where("event_type = 'other'").count() > 0
