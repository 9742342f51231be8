"""Dead letters sent through again, each at most once.

What a replay repairs goes into the event table and the counters under a batch number of
its own, then its letters are entered in a ledger. A replay that is lost on the way has no
entry: the next one takes the same number and replaces whatever was written. Letters in
the ledger are left out from then on, and what stays broken waits for another repair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate, enrich, routing
from . import tables as stored
from .tables import Tables

FIRST_BATCH = 1 << 40       # numbers of replays follow those of any stream
LEDGER_DDL = "letter string, replay_id bigint"


def ledger(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(letter, replay_id)``: letters that reached the event table, by digest of their text."""
    return spark.read.schema(LEDGER_DDL).parquet(f"{tables.root}/replayed")


def next_number(spark: SparkSession, tables: Tables) -> int:
    """The number after the last finished replay; a folder counts once it is complete."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(f"{tables.root}/replayed")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.Path(root, "replay_id=*/_SUCCESS")) or ()
    return max((int(s.getPath().getParent().getName().partition("=")[2]) + 1 for s in done), default=0)


def waiting(spark: SparkSession, tables: Tables) -> DataFrame:
    """``(letter, raw, reason)`` of dead letters not replayed yet; equal texts are one letter."""
    letters = (tables.read_dead_letters(spark).where("raw is not null")
               .groupBy(F.sha2("raw", 256).alias("letter"))
               .agg(F.any_value("raw").alias("raw"), F.any_value("reason").alias("reason")))
    if not next_number(spark, tables):
        return letters
    return letters.join(ledger(spark, tables).select("letter"), "letter", "left_anti")


def replay(spark: SparkSession, tables: Tables, repair: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Repairs the waiting letters, stores the good ones; returns the replay's number.

    ``repair`` maps messages to messages and may change their ``value``; it must keep the
    other columns. Events, increments and ledger are each a folder that is replaced whole.
    """
    number = next_number(spark, tables)
    messages = waiting(spark, tables).select("letter", F.col("raw").alias("value"))
    parsed = routing.parse_messages(repair(messages) if repair else messages, keep=("letter",))
    staged = f"{tables.root}/replaying"
    parsed.where("reason IS NULL").drop("raw", "reason").write.mode("overwrite").parquet(staged)
    good = spark.read.schema(parsed.drop("raw", "reason").schema).parquet(staged)
    events = good.drop("letter")
    stored.write_events(enrich.enrich(stored.laid_out(events)), tables, FIRST_BATCH + number)
    stored.write_increments(aggregate.window_counts(events), tables, FIRST_BATCH + number)
    good.select("letter").write.mode("overwrite").parquet(f"{tables.root}/replayed/replay_id={number}")
    return number
