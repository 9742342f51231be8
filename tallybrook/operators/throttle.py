"""Token-bucket replay over request logs: which requests would be refused.

The decision on a request depends on every earlier request of its key, so a key is
replayed in time order. Two kinds of keys are treated apart:

* **Ordinary keys** go to one task each, sorted, and stream through it in Arrow
  batches. The task keeps one number per key.
* **Busy keys**, those with more than ``busy_rows`` requests, are cut into stretches
  of about as many requests each, which different tasks handle. First each stretch is
  summed up as a ``Transfer`` (what it does to any incoming state), then the short list of
  transfers is chained per key, which gives every stretch its true incoming state.
  Decisions are the same as without the cut.

At most ``MAX_BUSY`` keys are treated as busy, the busiest first. With N requests, a
key left out of that list has at most N / MAX_BUSY of them, and the list stays small
enough to broadcast whatever N is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.arrow import runs
from ..functions.bucket import UNUSED, TokenBucket, Transfer
from ..functions.time import micros

BUSY_ROWS = 5_000_000
MAX_BUSY = 10_000
MAX_STRETCHES = 4096
MAX_CUTS = 1 << 20   # of all busy keys together, about
PER_CUT = 64         # requests looked at for each cut, about
ORDINARY = -1   # stretch number of keys that are not cut
UNTIMED = -2    # and, downwards, of requests without a time, which need no order
SPREAD = 4096

_BLOCK, _T, _STATE, _LAST, _CUTS = "_stretch", "_t", "_full_at", "_last_at", "_cuts"


def replay(requests: DataFrame, bucket: TokenBucket = TokenBucket(), *,
           key: str = "api_key", at: str = "timestamp", tie: str = "id",
           initial: DataFrame | None = None, busy_rows: int = BUSY_ROWS,
           stretch_rows: int | None = None) -> DataFrame:
    """Adds ``allowed``, ``tokens_left`` and ``full_at`` to every request.

    ``tokens_left`` counts whole tokens right after the decision; ``full_at`` is the
    bucket's state then (scaled microseconds). ``initial`` holds states to start
    from, as ``final_states`` returns them. A request earlier than the last one its
    key has already been served is treated as if it came at that time. Requests
    without a time get no decision.
    """
    timed = requests.withColumn(_T, micros(at) * bucket.scale)
    busy = _busy_keys(timed, key, busy_rows, stretch_rows or max(1, busy_rows // 16), initial)
    placed = _place(timed, busy, key, tie, "left")
    cut = _transfers(_place(timed.where(F.col(_T).isNotNull()), busy, key, tie, "inner"), key, bucket)
    starts = _chain(cut, None if initial is None else busy, key, bucket)
    if initial is not None:
        known = initial.select(F.col(key), F.lit(ORDINARY).alias(_BLOCK),
                               F.col("full_at").alias(_STATE), F.col("last_at").alias(_LAST))
        starts = starts.unionByName(known, allowMissingColumns=True)
    return _decide(placed, starts, requests, key, tie, bucket)


def final_states(decisions: DataFrame, *, key: str = "api_key", at: str = "timestamp",
                 bucket: TokenBucket = TokenBucket()) -> DataFrame:
    """State of every key after its last request. States only grow, so a max will do."""
    return (decisions.where(F.col(at).isNotNull()).groupBy(key)
            .agg(F.max("full_at").alias("full_at"),
                 F.max(micros(at) * bucket.scale).alias("last_at")))


def tokens_remaining(keys: DataFrame, states: DataFrame, now, *,
                     bucket: TokenBucket = TokenBucket(), key: str = "api_key") -> DataFrame:
    """Whole tokens of each key at time ``now``; an unseen key has a full bucket."""
    t = micros(now) * bucket.scale
    owed = F.greatest(F.col("full_at") - t, F.lit(0))
    left = F.lit(bucket.capacity * bucket.cost) - owed
    return (keys.join(states, key, "left")
            .withColumn("tokens_left", F.coalesce(
                F.floor(left / bucket.cost).cast("int"), F.lit(bucket.capacity)))
            .select(*keys.columns, "tokens_left"))


def _busy_keys(timed, key, busy_rows, stretch_rows, initial) -> DataFrame:
    """Busy keys and the times at which they are cut; MAX_BUSY rows at most.

    A key with n requests gets a cut for every ``stretch_rows`` of them, and fewer where
    the cuts of all keys would be more than MAX_CUTS. Cuts are quantiles of the times,
    taken from the requests whose time has a certain hash, about PER_CUT of them a cut.
    """
    n = F.col("n")
    long = F.greatest(F.lit(stretch_rows), F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / MAX_CUTS))
    busy = (
        timed.groupBy(key).agg(F.count(_T).alias("n"))
        .where(n > busy_rows).orderBy(n.desc(), F.col(key)).limit(MAX_BUSY)
        .select(key, "n", F.least(F.ceil(n / long), F.lit(MAX_STRETCHES)).cast("int").alias("stretches"))
    )
    keys = F.broadcast(busy.withColumnRenamed(key, "_key"))
    every = F.greatest(F.lit(1), F.floor(n / (F.col("stretches") * PER_CUT)))
    # one literal: a list of so many would slow down planning
    shares = F.split(F.lit(",".join(str(i / MAX_STRETCHES) for i in range(1, MAX_STRETCHES))), ",").cast("array<double>")
    wanted = F.when(F.col("stretches") > 1, F.sequence(F.lit(1), F.col("stretches") - 1))
    cuts = (
        timed.join(keys, timed[key].eqNullSafe(F.col("_key")))
        .where(F.pmod(F.xxhash64(_T), every) == 0)
        .groupBy("_key", "stretches").agg(F.percentile_approx(_T, shares, MAX_STRETCHES).alias("all"))
        .select(F.col("_key").alias("_owner"), F.array_distinct(F.transform(
            wanted, lambda i: F.get("all", F.floor(i * MAX_STRETCHES / F.col("stretches")).cast("int") - 1)))
            .alias(_CUTS))
    )
    busy = (busy.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_owner")), "left")
            .select(key, F.coalesce(_CUTS, F.array().cast("array<bigint>")).alias(_CUTS)))
    if initial is None:
        return busy.withColumns({_STATE: F.lit(None).cast("bigint"),
                                 _LAST: F.lit(None).cast("bigint")})
    same = busy[key].eqNullSafe(initial[key])
    return busy.join(initial, same, "left").select(
        busy["*"], initial["full_at"].alias(_STATE), initial["last_at"].alias(_LAST))


def _place(timed, busy, key, tie, how) -> DataFrame:
    """Gives each request its stretch: the number of cuts that are not after it.

    Joined "inner" it yields the requests of busy keys only; with none, adaptive
    execution drops that side of the plan.
    """
    b = F.broadcast(busy.withColumnRenamed(key, "_key"))
    halves = F.array(*(F.lit(1 << i) for i in reversed(range((MAX_STRETCHES - 1).bit_length()))))
    at = F.aggregate(halves, F.lit(0), lambda low, step: F.when(
        F.get(_CUTS, low + step - 1) <= F.col(_T), low + step).otherwise(low))
    stretch = (F.when(F.col(_T).isNull(), F.lit(UNTIMED) - F.pmod(F.xxhash64(tie), F.lit(SPREAD)))
               .when(F.col(_CUTS).isNull(), ORDINARY).otherwise(at).cast("int"))
    return (timed.join(b, timed[key].eqNullSafe(F.col("_key")), how)
            .select(timed["*"], stretch.alias(_BLOCK), F.col(_LAST).alias("_floor"))
            .withColumn(_T, F.when(F.col(_T).isNotNull(), F.greatest(_T, "_floor")))
            .drop("_floor"))


def _transfers(placed, key, bucket) -> DataFrame:
    """One ``Transfer`` per stretch: its pieces in arrays, the first ``head`` set aside."""
    rows = (placed.select(key, _BLOCK, _T).repartition(key, _BLOCK)
            .sortWithinPartitions(key, _BLOCK, _T))
    schema = T.StructType([rows.schema[key], rows.schema[_BLOCK],
                           T.StructField("lo", T.ArrayType(T.LongType())),
                           T.StructField("moving", T.ArrayType(T.BooleanType())),
                           T.StructField("off", T.ArrayType(T.LongType())),
                           T.StructField("head", T.IntegerType())])

    def sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        current, transfer = None, None

        def emit():
            (owner, block), head = current, transfer.head or []
            lo, moving, off = map(list, zip(*head, *transfer.pieces))
            return pa.RecordBatch.from_arrays(
                [pa.array([owner], types[0]), pa.array([block], pa.int32()),
                 pa.array([lo], pa.list_(pa.int64())), pa.array([moving], pa.list_(pa.bool_())),
                 pa.array([off], pa.list_(pa.int64())), pa.array([len(head)], pa.int32())],
                names=[f.name for f in schema])

        for batch in batches:
            types = [c.type for c in batch.columns]
            times = batch.column(2).to_numpy()
            for a, z in runs(batch, 0, 1):
                here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if transfer is None or here != current:
                    if transfer is not None:
                        yield emit()
                    current, transfer = here, Transfer(bucket)
                transfer.feed(times[a:z])
        if transfer is not None:
            yield emit()

    return rows.mapInArrow(sum_up, schema)


def _chain(transfers, busy, key, bucket) -> DataFrame:
    """Incoming state of every stretch, from the transfers before it."""
    if busy is None:
        rows = transfers.withColumn(_STATE, F.lit(None).cast("bigint"))
    else:
        first = busy.select(F.col(key).alias("_key"), F.col(_STATE))
        same = transfers[key].eqNullSafe(F.col("_key"))
        rows = transfers.join(F.broadcast(first), same, "left").drop("_key")
    rows = rows.repartition(key).sortWithinPartitions(key, _BLOCK)
    schema = T.StructType([rows.schema[key], rows.schema[_BLOCK],
                           T.StructField(_STATE, T.LongType())])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, state = False, None, None
        for batch in batches:
            states = []
            for owner, lo, moving, off, head, given in zip(*(
                    batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if not started or owner != current:
                    started, current = True, owner
                    state = UNUSED if given is None else given
                states.append(state)
                step, pieces = Transfer(bucket), list(zip(lo, moving, off))
                step.head, step.pieces = pieces[:head] or None, pieces[head:]
                state = step.apply(state)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(states, pa.int64())],
                names=[f.name for f in schema])

    return rows.mapInArrow(chain, schema)


def _decide(placed, starts, requests, key, tie, bucket) -> DataFrame:
    """Replays each stretch from its incoming state.

    The states travel as marker rows that sort ahead of the requests of their
    stretch: one shuffle brings both together, and no join can skew.
    """
    state, last = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    body = placed.withColumns({_STATE: state, _LAST: last, "_request": F.lit(True)})
    marks = starts.withColumn("_request", F.lit(False))
    if _LAST not in marks.columns:
        marks = marks.withColumn(_LAST, last)
    rows = (body.unionByName(marks, allowMissingColumns=True)
            .repartition(key, _BLOCK)
            .sortWithinPartitions(key, _BLOCK, "_request", _T, tie))
    kept = requests.columns
    at = {c: rows.columns.index(c) for c in (key, _BLOCK, _T, _STATE, _LAST, "_request")}
    keep = [rows.columns.index(c) for c in kept]
    names = [*kept, "allowed", "tokens_left", "full_at"]
    schema = T.StructType([*requests.schema.fields,
                           T.StructField("allowed", T.BooleanType()),
                           T.StructField("tokens_left", T.IntegerType()),
                           T.StructField("full_at", T.LongType())])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, full_at, floor = None, UNUSED, UNUSED
        for batch in batches:
            column = {c: batch.column(i) for c, i in at.items()}
            request = column["_request"].to_numpy(zero_copy_only=False)
            timed = column[_T].is_valid().to_numpy(zero_copy_only=False)
            times = column[_T].fill_null(0).to_numpy().copy()
            allowed, states = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64)
            for a, z in runs(batch, at[key], at[_BLOCK]):
                here = (column[key][a].as_py(), column[_BLOCK][a].as_py())
                if here != current:
                    current, full_at, floor = here, UNUSED, UNUSED
                # first the marker, if any, then requests without a time, then the rest
                while a < z and not (request[a] and timed[a]):
                    if not request[a]:
                        full_at = column[_STATE][a].as_py()
                        floor = column[_LAST][a].as_py() or UNUSED
                    a += 1
                if a == z:
                    continue
                if times[a] < floor:
                    np.maximum(times[a:z], floor, out=times[a:z])
                allowed[a:z], states[a:z] = bucket.serve(times[a:z].tolist(), full_at)
                full_at = int(states[z - 1])
            keep_rows, none = pa.array(request), ~timed[request]
            rows_in = batch.filter(keep_rows)
            left = bucket.tokens(states, times).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(rows_in.column(i) for i in keep),
                 pa.array(allowed[request], mask=none), pa.array(left[request], mask=none),
                 pa.array(states[request], mask=none)], names=names)

    return rows.mapInArrow(decide, schema)
