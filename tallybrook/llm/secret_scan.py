"""Secrets in texts: base patterns, and entropy of sliding windows per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import store

# Base patterns, in the order in which kinds are listed.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_mixed")

# Texts without a match of these hold no base or entropy span; a linear-time search.
MAY_HOLD = (r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}"
            r"|[0-9a-f]{32}|[A-Za-z0-9+/_=-]{20}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Placeholders and well-known public strings that look random; matched on the candidate.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)0123456789|abcdefghijk|qwertyuiop",
    r"^(.{1,4})\1{4,}",
)


@dataclass(frozen=True)
class CharClass:
    """Windows of ``width`` characters of ``chars`` with ``bits`` of entropy or more."""
    kind: str
    chars: str
    width: int
    bits: float
    needs: tuple[str, ...]      # each of these sets has a character in the window


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", 24, 3.0, (DIGITS, "abcdefABCDEF")),
    CharClass("entropy_upper", DIGITS + UPPER, 20, 3.5, (DIGITS, UPPER)),
    CharClass("entropy_mixed", DIGITS + LOWER + UPPER + "+/_=-", 24, 3.8, (DIGITS, LOWER, UPPER)),
)


def windows(text: str, cls: CharClass) -> Iterator[tuple[int, int]]:
    """Merged spans of windows that pass. Counts change by two characters per step.

    The entropy of a window of w characters is log2 w - (sum of c log2 c) / w, so a step
    updates the sum for the character that leaves and the one that enters.
    """
    w, chars = cls.width, frozenset(cls.chars)
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    most = w * (math.log2(w) - cls.bits)     # the sum may not exceed this
    start = end = None
    run = 0
    counts: dict[str, int] = {}
    needs = [0] * len(cls.needs)
    total = 0.0
    for i, c in enumerate(text):
        if c not in chars:
            run, counts, needs, total = 0, {}, [0] * len(cls.needs), 0.0
            continue
        if run == w:
            old = text[i - w]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
            for k, need in enumerate(cls.needs):
                needs[k] -= old in need
        else:
            run += 1
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        for k, need in enumerate(cls.needs):
            needs[k] += c in need
        if run == w and total <= most + 1e-9 and all(needs):
            if start is not None and i - w + 1 > end:
                yield start, end
                start = None
            start, end = (i - w + 1 if start is None else start), i + 1
    if start is not None:
        yield start, end


class Scanner:
    def __init__(self, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED):
        self.assign, self.access = re.compile(ASSIGN), re.compile(ACCESS)
        self.hex = re.compile(HEX.removesuffix("+") + "{%d,}" % LEAST_HEX)
        self.classes, self.allowed = classes, [re.compile(a) for a in allowed]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans; a match that is too short is used up all the same."""
        found = [(m.start(), m.end(), "assign") for m in self.assign.finditer(text)
                 if len(m[2]) >= LEAST_VALUE]
        found += [(m.start(), m.end(), "access") for m in self.access.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
        found += [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]
        return found

    def random_looking(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of high entropy within candidates that no allow-list pattern fits."""
        found = []
        for m in CANDIDATE.finditer(text):
            value = m[0]
            if not any(c in DIGITS for c in value) or any(a.search(value) for a in self.allowed):
                continue
            found += [(m.start() + a, m.start() + b, c.kind)
                      for c in self.classes for a, b in windows(value, c)]
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans by start, then kind as listed, then end."""
        return sorted(self.base(text) + self.random_looking(text),
                      key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
         scanner: Scanner | None = None) -> DataFrame:
    """Adds ``spans`` (code points, end exclusive) to the columns of ``keep``.

    Null and empty texts have an empty list. Every row is answered by itself, repeated
    rows alike; a very long text is handled alone. Columns outside ``keep`` are dropped,
    so their names cannot clash. Texts that a linear search shows to hold no beginning of
    any span skip the exact patterns.
    """
    use = scanner or Scanner()
    rows = docs.select(*keep, docs[text].alias("_text"))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "_text"):
            array = store.texts(batch, "_text")
            out: list = [[]] * len(batch)
            hits = np.flatnonzero(pc.match_substring_regex(array, MAY_HOLD)
                                  .to_numpy(zero_copy_only=False))
            for i, value in zip(hits.tolist(), array.take(pa.array(hits)).to_pylist()):
                out[i] = [{"kind": k, "start": a, "end": b} for a, b, k in use.spans(value)]
            yield pa.RecordBatch.from_arrays(
                [*(store.column(batch, k) for k in keep), pa.array(out, arrow)],
                names=[*keep, "spans"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{schema}, {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """All columns of ``docs``, every secret in ``text`` replaced by ``mark``.

    Spans that touch or overlap become one mark. ``n_chars``, where there is such a
    column, follows the new text; a null text stays null.
    """
    use, names = scanner or Scanner(), docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        parts, last = [], 0
        for a, b, _ in use.spans(value):
            if a > last or not parts:
                parts += [value[last:a], mark]
            last = max(last, b)
        return "".join(parts) + value[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            columns = list(batch.columns)
            hit = pc.fill_null(pc.match_substring_regex(columns[at], MAY_HOLD), False)
            if pc.any(hit).as_py():
                values = [clean(v) if h else v for v, h in
                          zip(columns[at].to_pylist(), hit.to_pylist())]
                columns[at] = pa.array(values, columns[at].type)
                if counted is not None:
                    columns[counted] = pc.if_else(
                        hit, pc.utf8_length(columns[at]).cast(columns[counted].type), columns[counted])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
