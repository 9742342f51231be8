import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest

from tallybrook.functions.bucket import UNUSED, TokenBucket, Transfer
from tallybrook.operators import throttle

T0 = dt.datetime(2024, 1, 1)


def plain(requests, capacity, rate):
    """Straight reading of the rule in floating point, one key after another."""
    out, buckets = {}, {}
    for i, key, t in sorted(requests, key=lambda r: (r[2], r[0])):
        tokens, last = buckets.get(key, (float(capacity), t))
        tokens = min(capacity, tokens + (t - last).total_seconds() * rate)
        ok = tokens >= 1.0
        buckets[key] = (tokens - 1.0 if ok else tokens, t)
        out[i] = ok
    return out


def frame(spark, requests):
    return spark.createDataFrame(requests, "id long, api_key string, timestamp timestamp")


def decisions(df):
    return {r.id: r.allowed for r in df.collect()}


def ms(n):
    return T0 + dt.timedelta(milliseconds=n)


def test_burst_then_denied(spark):
    reqs = [(i, "a", T0) for i in range(101)] + [(200, "b", T0)]
    got = decisions(throttle.replay(frame(spark, reqs)))
    assert [got[i] for i in range(101)] == [True] * 100 + [False]
    assert got[200]


def test_refill_and_cap(spark):
    reqs = [(i, "a", T0) for i in range(100)] + [(i, "a", ms(150)) for i in range(100, 105)]
    got = decisions(throttle.replay(frame(spark, reqs)))
    assert [got[i] for i in range(100, 105)] == [True] * 3 + [False] * 2
    reqs = [(i, "a", T0) for i in range(10)] + [(i, "a", ms(500)) for i in range(10, 160)]
    got = decisions(throttle.replay(frame(spark, reqs)))
    assert sum(got[i] for i in range(10, 160)) == 100


def test_fifty_keys_ten_requests(spark):
    reqs = [(k * 10 + i, f"k{k}", T0) for k in range(50) for i in range(10)]
    assert all(decisions(throttle.replay(frame(spark, reqs))).values())


@pytest.mark.parametrize("load", [0.5, 1.1, 20])
def test_busy_key_cut_in_stretches_equals_plain_replay(spark, load):
    rng = random.Random(7)
    bucket = TokenBucket(6, 2)
    reqs, t = [], 0.0
    for i in range(1500):
        t += rng.expovariate(2 * load)
        reqs.append((i, "hot", T0 + dt.timedelta(microseconds=int(t * 1e6))))
    reqs += [(5000 + i, rng.choice("xyz"), ms(rng.randrange(60_000))) for i in range(200)]
    df = frame(spark, reqs)
    cut = decisions(throttle.replay(df, bucket, busy_rows=300, stretch_rows=90))
    assert cut == decisions(throttle.replay(df, bucket)) == plain(reqs, 6, 2)


def test_replay_in_two_parts_equals_one(spark):
    rng = random.Random(3)
    bucket = TokenBucket(5, 1)
    reqs = [(i, rng.choice("aab"), ms(rng.randrange(300_000))) for i in range(800)]
    df = frame(spark, reqs)
    half = ms(150_000)
    for busy in (10_000, 100):
        first = throttle.replay(df.where(df.timestamp < half), bucket, busy_rows=busy,
                                stretch_rows=50)
        states = throttle.final_states(first, bucket=bucket)
        second = throttle.replay(df.where(df.timestamp >= half), bucket, initial=states,
                                 busy_rows=busy, stretch_rows=50)
        assert decisions(first.unionByName(second)) == plain(reqs, 5, 1)


def test_late_request_counts_as_now_and_null_time_is_kept(spark):
    bucket = TokenBucket(2, 1)
    first = throttle.replay(frame(spark, [(1, "a", ms(10_000)), (2, "a", ms(10_000))]), bucket)
    states = throttle.final_states(first, bucket=bucket)
    late = frame(spark, [(3, "a", ms(2_000)), (4, "a", ms(11_000)), (5, "a", None)])
    for busy in (100, 1):
        got = decisions(throttle.replay(late, bucket, initial=states, busy_rows=busy,
                                        stretch_rows=1))
        assert got == {3: False, 4: True, 5: None}


def test_null_key_is_a_key(spark):
    reqs = [(i, None, T0) for i in range(7)] + [(9, "a", T0)]
    for busy in (100, 2):
        got = decisions(throttle.replay(frame(spark, reqs), TokenBucket(5, 1), busy_rows=busy))
        assert [got[i] for i in range(7)] == [True] * 5 + [False] * 2 and got[9]


def test_tokens_remaining(spark):
    bucket = TokenBucket(5, 1)
    done = throttle.replay(frame(spark, [(1, "a", T0), (2, "a", T0), (3, "a", T0)]), bucket)
    keys = spark.createDataFrame([("a",), ("new",)], "api_key string")
    from pyspark.sql import functions as F
    left = throttle.tokens_remaining(keys, throttle.final_states(done, bucket=bucket),
                                     F.lit(ms(1500)), bucket=bucket)
    assert {r.api_key: r.tokens_left for r in left.collect()} == {"a": 3, "new": 5}


def test_transfer_equals_fold_for_any_start():
    rng = np.random.default_rng(1)
    for _ in range(60):
        bucket = TokenBucket(int(rng.integers(1, 12)), int(rng.choice([20, 50, 7])))
        n = int(rng.integers(1, 200))
        gap = bucket.cost / float(rng.choice([.3, 1.1, 3, 30]))
        times = np.cumsum(rng.exponential(gap, n)).astype(np.int64) + 10**6
        cut = int(rng.integers(0, n + 1))
        transfer = Transfer(bucket)
        transfer.feed(times[:cut])
        transfer.feed(times[cut:])
        top = int(times[0]) + bucket.capacity * bucket.cost
        for start in [UNUSED, int(times[0]), top, *map(int, rng.integers(times[0], top, 20))]:
            assert transfer.apply(start) == bucket.serve(times.tolist(), start)[1][-1]


def test_slow_rates_are_exact():
    b = TokenBucket(5, Fraction(2, 86400))
    assert (b.cost, b.scale) == (43_200_000_000, 1)
    with pytest.raises(ValueError):
        TokenBucket(5, Fraction(1234567, 1000003))
