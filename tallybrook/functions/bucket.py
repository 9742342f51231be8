"""Token-bucket arithmetic on whole numbers.

A bucket of ``capacity`` tokens, refilled at a steady rate, is described by one
number: the time at which it will be full again. With ``cost`` the time one token
takes to refill, and ``slack = (capacity - 1) * cost``:

    a request at ``t`` passes  if  max(full_at, t) <= t + slack
    and then                       full_at = max(full_at, t) + cost
    tokens at ``t``            =   capacity - max(full_at - t, 0) / cost

A refused request leaves ``full_at`` alone, so the refill goes on. Times are
microseconds times ``scale``, with ``scale`` chosen to make ``cost`` a whole number;
no rounding error builds up, however long the log.

``Transfer`` is what a run of requests does to *any* incoming ``full_at``. It lets
the stretches of one busy key be worked on apart and joined again exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np


# state of a bucket never used: full since long ago
UNUSED = -(2 ** 62)


@dataclass(frozen=True)
class TokenBucket:
    # fixed values, as defaults
    capacity: int = 100
    refill_per_second: Fraction | int = 20

    def __post_init__(self):
        if self.capacity < 1 or self.refill_per_second <= 0:
            raise ValueError("a bucket needs a capacity and a refill rate above zero")
        if self.scale > 2000:
            raise ValueError("refill rate: one token must take a whole number of "
                             "microseconds, or a fraction of at most 1/2000")

    @cached_property
    def _period(self) -> Fraction:
        return Fraction(1_000_000) / Fraction(self.refill_per_second)

    @cached_property
    def scale(self) -> int:
        return self._period.denominator

    @cached_property
    def cost(self) -> int:
        return self._period.numerator

    @cached_property
    def slack(self) -> int:
        return (self.capacity - 1) * self.cost

    def serve(self, times: list[int], full_at: int) -> tuple[list[bool], list[int]]:
        """Decision on, and state after, each request at ascending scaled times."""
        cost, slack = self.cost, self.slack
        allowed, states = [], []
        for t in times:
            base = full_at if full_at > t else t
            if base <= t + slack:
                full_at = base + cost
                allowed.append(True)
            else:
                allowed.append(False)
            states.append(full_at)
        return allowed, states

    def tokens(self, full_at, t):
        """Whole tokens in the bucket at scaled time ``t``; for arrays as well."""
        return (self.capacity * self.cost - np.maximum(full_at - t, 0)) // self.cost


class Transfer:
    """Incoming ``full_at`` -> outgoing ``full_at`` over a run of requests.

    Piecewise: pieces are ``(lo, moving, off)``, each reaching up to the next ``lo``.
    The outcome is ``off``, plus the incoming value where the piece is ``moving``. A
    piece stops moving once its bucket has run full, because from then on the past no
    longer matters. Neighbours with the same outcome are merged.

    Once every bucket has less than one token, all outcomes lie within one ``cost`` of
    each other. The pieces so far are then set aside as ``head``, and a fresh set is
    kept for that short range. It has a handful of pieces, whatever the capacity.
    """

    def __init__(self, bucket: TokenBucket):
        self.bucket = bucket
        self.head: list[tuple] | None = None
        self.pieces: list[tuple] | None = None
        self._hi = self._low = self._last = 0

    def feed(self, times: np.ndarray) -> None:
        """Takes in more requests: scaled times, ascending, none before the last."""
        if not len(times):
            return
        b, ts = self.bucket, times.tolist()
        if self.pieces is None:
            # anything earlier is a full bucket; nothing later can be handed over
            self._begin(ts[0], ts[0] + b.capacity * b.cost)
            self._last = ts[0]
        gaps = np.diff(times, prepend=self._last)
        breaks = np.flatnonzero(gaps > min(b.cost, b.slack)).tolist()
        i, n, at = 0, len(ts), 0
        while i < n:
            if len(self.pieces) == 1 and not self.pieces[0][1]:
                self._feed_one_state(ts[i:])
                break
            if self._low > self._last + b.slack:
                if self.head is None:
                    self.head = self.pieces
                    self._begin(self._last + b.slack + 1, self._last + b.slack + b.cost)
                # up to the next break no bucket gains a second token
                while at < len(breaks) and breaks[at] < i:
                    at += 1
                end = breaks[at] if at < len(breaks) else n
                if end > i:
                    self._jump(ts[end - 1])
                    i = end
                    continue
            self._step(ts[i])
            i += 1
        self._last = ts[-1]

    def apply(self, full_at: int) -> int:
        s = full_at
        for pieces in (self.head, self.pieces):
            if pieces is not None:
                s = max(s, pieces[0][0])
                _, moving, off = pieces[bisect_right(pieces, s, key=lambda p: p[0]) - 1]
                s = off + s if moving else off
        return s

    # -- internals ---------------------------------------------------------

    def _begin(self, lo: int, hi: int) -> None:
        self.pieces, self._hi, self._low = [(lo, True, 0)], hi, lo

    def _ends(self):
        return zip(self.pieces, [p[0] - 1 for p in self.pieces[1:]] + [self._hi])

    def _take(self, parts: list[tuple]) -> None:
        """Sets the pieces, neighbours with the same outcome as one."""
        merged = [parts[0]]
        for part in parts[1:]:
            if part[1] != merged[-1][1] or part[2] != merged[-1][2]:
                merged.append(part)
        self.pieces = merged
        self._low = min(off + lo if moving else off for lo, moving, off in merged)

    def _step(self, t: int) -> None:
        cost, edge = self.bucket.cost, t + self.bucket.slack
        self._last = t
        if self._low > edge:
            return
        parts = []
        for (lo, moving, off), hi in self._ends():
            if not moving:
                parts.append((lo, False, t + cost if off <= t
                              else off + cost if off <= edge else off))
                continue
            if lo <= t - off:               # full again by now
                parts.append((lo, False, t + cost))
                lo = t - off + 1
            if lo <= min(hi, edge - off):   # passes
                parts.append((lo, True, off + cost))
                lo = edge - off + 1
            if lo <= hi:                    # refused
                parts.append((lo, True, off))
        self._take(parts)

    def _jump(self, t: int) -> None:
        """Many requests at once, all buckets drained: a token goes as it comes."""
        cost, edge = self.bucket.cost, t + self.bucket.slack
        self._last = t
        parts = []
        for (lo, moving, off), hi in self._ends():
            base = off if moving else off - lo
            while lo <= hi:
                spent = max(0, (edge - base - lo) // cost + 1)
                parts.append((lo, moving, off + cost * spent))
                if not moving or not spent:
                    break
                lo = edge - base - (spent - 1) * cost + 1
        self._take(parts)

    def _feed_one_state(self, ts: list[int]) -> None:
        lo, _, state = self.pieces[0]
        state = self.bucket.serve(ts, state)[1][-1]
        self.pieces, self._low = [(lo, False, state)], state
