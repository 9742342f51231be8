"""Folding of counter increments: sums stay the same, whatever is lost on the way."""

import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallybrook.operators import aggregate
from tallybrook.session import configure
from tallybrook.sources import adapter, lookups, tables as stored
from tallybrook.sources.tables import Tables
from tallybrook.streaming import jobs


@pytest.fixture
def tables(spark, sf, tmp_path):
    configure(spark)
    made = Tables(str(tmp_path))
    for batch in range(4):
        _store(spark, sf, made, batch)
    return made


def _store(spark, sf, tables, batch):
    events = adapter.load_events(spark, sf).where(F.pmod("id", F.lit(5)) == batch)
    events = events.withColumns({"user_id": F.col("user_id").cast("string"), "timestamp": F.col("timestamp").cast("timestamp")})
    stored.write_increments(aggregate.window_counts(events), tables, batch)


def folders(path):
    return sorted(n for n in os.listdir(path) if "=" in n) if os.path.isdir(path) else []


def test_folds_change_no_sum_and_few_folders_stay(spark, sf, tables):
    want = rows(tables.read_counters(spark))
    assert stored.fold_increments(spark, tables, before=3) == 0
    assert stored.loose_batches(spark, tables) == [3] and rows(tables.read_counters(spark)) == want
    assert stored.drop_folded(spark, tables) == 3 and stored.drop_folded(spark, tables) == 0
    assert folders(tables.increments) == ["batch_id=3"] and rows(tables.read_counters(spark)) == want
    _store(spark, sf, tables, 4)
    everything = aggregate.daily_counts(adapter.load_events(spark, sf)).withColumn("user_id", F.col("user_id").cast("string"))
    columns = ["user_id", "event_type", "time_bucket", "event_count"]
    assert rows(tables.read_counters(spark), *columns) == rows(everything, *columns)
    assert stored.fold_increments(spark, tables) == 1 and stored.fold_increments(spark, tables) is None
    assert stored.drop_folded(spark, tables) == 2 and folders(tables.increments) == []
    assert rows(tables.read_counters(spark), *columns) == rows(everything, *columns)


def test_a_folded_batch_that_runs_again_counts_once(spark, sf, tables):
    want = rows(tables.read_counters(spark))
    stored.fold_increments(spark, tables)
    stored.drop_folded(spark, tables)
    _store(spark, sf, tables, 2)
    assert rows(tables.read_counters(spark)) == want and stored.loose_batches(spark, tables) == []
    assert stored.fold_increments(spark, tables) is None


def test_a_lost_fold_is_done_again(spark, sf, tables, monkeypatch):
    want, write = rows(tables.read_counters(spark)), stored._write_batch

    def lost(df, path, *args, **options):
        if path == tables.folds:
            raise RuntimeError("lost")
        write(df, path, *args, **options)

    monkeypatch.setattr(stored, "_write_batch", lost)
    with pytest.raises(RuntimeError):
        stored.fold_increments(spark, tables)
    monkeypatch.setattr(stored, "_write_batch", write)
    assert folders(tables.counts) == ["fold_id=0"] and rows(tables.read_counters(spark)) == want
    assert stored.drop_folded(spark, tables) == 0
    assert stored.fold_increments(spark, tables) == 0 and rows(tables.read_counters(spark)) == want


def test_half_written_batches_wait(spark, sf, tables):
    os.remove(f"{tables.increments}/batch_id=1/_SUCCESS")
    stored.fold_increments(spark, tables)
    assert stored.loose_batches(spark, tables) == [1]


def test_lookups_prune_folds_and_retention_removes_their_days(spark, sf, tables):
    user, day = tables.read_counters(spark).orderBy("time_bucket", "user_id").select("user_id", "time_bucket").first()
    want = rows(lookups.counter(spark, tables, user, None, day, day))
    stored.fold_increments(spark, tables)
    found = lookups.counter(spark, tables, user, None, day, day)
    assert rows(found) == want
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(time_bucket" in text and f"EqualTo(user_id,{user})" in text
    days = sorted({r[2] for r in rows(tables.read_counters(spark), "user_id", "event_type", "time_bucket")})
    assert jobs.drop_expired(spark, tables.counts, days[3]) == days[:3]
    assert min(r[0] for r in rows(tables.read_counters(spark).where("time_bucket >= '%s'" % days[3]), "time_bucket")) == days[3]
