"""Order MinHash: fingerprints of texts whose likeness follows edit distance.

A text is its k-mers of characters, each with the number of its occurrence, so that
repeats differ. For each of many hash functions the ``TUPLE`` smallest are selected, put
back into text order, and hashed as a tuple. Two texts agree on a function when they
share those k-mers *and* their order, which insertions, deletions and moved passages
disturb as edit distance does; a set of k-mers alone would not see order.

A function's value for a k-mer holds its position in the low bits, so one pass of minima
gives both. Equal texts have equal fingerprints; the hash is fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import store, words

GRAM = 8              # characters of a k-mer
TUPLE = 2             # k-mers of a tuple
SIZE = 64             # tuples of a fingerprint
SLICE_BYTES = 1 << 18  # text fingerprinted at once, within a core's cache; a longer text is handled alone

_PAD = 0x110000           # after the last code point
_LOW = np.uint64(0xFFFFFFFF)
_END = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = words.mix(np.arange(1, 1 + 1024, dtype=np.uint64) * words.MULTIPLY) | np.uint64(1)


def code_points(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each text starts."""
    data, offsets = store.text_bytes(array)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:      # bytes that are no UTF-8 count as replacement characters
        return code_points(pa.array([t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in array]))
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, starts[offsets]


def kmers(points: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers of each text and where each text's begin.

    A text shorter than ``k`` is padded to one k-mer; an empty text has none.
    """
    length = np.diff(starts)
    if ((length > 0) & (length < k)).any():
        padded = np.where(length > 0, np.maximum(length, k), 0)
        at = np.concatenate(([0], np.cumsum(padded)))
        out = np.full(at[-1], _PAD, np.uint32)
        out[store.ranges(at[:-1], length)] = points
        points, starts, length = out, at, padded
    n = max(0, len(points) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled *= words.MULTIPLY
        rolled += points[i:i + n]
    counts = np.maximum(length - k + 1, 0)
    return words.mix(rolled[store.ranges(starts[:-1], counts)]), np.concatenate(([0], np.cumsum(counts)))


def occurrences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each value came before in its own text."""
    owner = np.repeat(words.mix(np.arange(1, len(starts), dtype=np.uint64)), np.diff(starts))
    keys = values ^ owner
    ordered = np.sort(keys)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(values), np.uint64)
    if len(repeated):
        # by their upper bits most of the others are told apart, without a search
        there = np.zeros(1 << 18, bool)
        there[repeated >> np.uint64(46)] = True
        at = np.flatnonzero(there[keys >> np.uint64(46)])
        slot = np.minimum(np.searchsorted(repeated, keys[at]), len(repeated) - 1)
        found = repeated[slot] == keys[at]
        at, slot = at[found], slot[found]
        some = at[np.argsort(slot, kind="stable")]
        first = np.concatenate(([0], np.flatnonzero(np.diff(keys[some])) + 1))
        size = np.diff(np.concatenate((first, [len(some)])))
        out[some] = (np.arange(len(some)) - np.repeat(first, size)).astype(np.uint64)
    return out


def _numbered(points: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """K-mers of each text and where each text's begin, with their occurrence, and places."""
    grams, at = kmers(points, starts, k)
    ids = words.mix(grams + occurrences(grams, at) * words.MULTIPLY)
    place = (np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
    return grams, at, ids, place


def _least(ids: np.ndarray, place: np.ndarray, first: np.ndarray, j: int, n: int, drawn: np.ndarray) -> np.ndarray:
    """The ``n`` least values of function ``j`` in each stretch of k-mers, places in the low
    bits. Stretches begin at ``first`` and reach up to the next one."""
    np.multiply(ids, _FACTORS[j], out=drawn)
    drawn &= ~_LOW
    drawn |= place
    origin, out = first - place[first].astype(np.int64), []
    for _ in range(n):
        least = np.minimum.reduceat(drawn, first)
        there = least != _END
        drawn[(origin + (least & _LOW).astype(np.int64))[there]] = _END
        out.append(least)
    return np.stack(out)


def _tuples(least: np.ndarray, first: np.ndarray, count: np.ndarray, grams: np.ndarray, j: int) -> np.ndarray:
    """The selected k-mers of each text, in text order, as one 16-bit value."""
    hashed = np.full(len(first), j + 1, np.uint64)
    chosen = np.where(least != _END, (least & _LOW).astype(np.int64), np.iinfo(np.int64).max)
    for position in np.sort(chosen, axis=0):
        there = position < count
        gram = grams[first + np.where(there, position, 0)]
        hashed = np.where(there, words.mix(hashed * words.MULTIPLY + gram), hashed)
    return words.mix(hashed) >> np.uint64(48)


def signatures(points: np.ndarray, starts: np.ndarray, k: int = GRAM, tuple_size: int = TUPLE,
               size: int = SIZE) -> np.ndarray:
    """One row of ``size`` 16-bit values per text.

    A text with fewer k-mers than a tuple takes gives shorter tuples; empty texts agree
    with each other only.
    """
    out = np.zeros((len(starts) - 1, size), np.uint16)
    grams, at, ids, place = _numbered(points, starts, k)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    first, count = at[full], np.diff(at)[full]
    drawn = np.empty_like(ids)
    for j in range(size):
        out[full, j] = _tuples(_least(ids, place, first, j, tuple_size, drawn), first, count, grams, j)
    return out


def signatures_beside(points: np.ndarray, starts: np.ndarray, changed: np.ndarray, at: np.ndarray, kept: np.ndarray,
                      k: int = GRAM, tuple_size: int = TUPLE, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """``signatures`` of all texts, and of the ``changed`` forms of all but the last, of which
    the first ``kept`` code points are unchanged.

    K-mers of the unchanged part have the same occurrences and places in both, so their least
    values are found once, and only the rest of either is drawn apart.
    """
    n = len(starts) - 1
    grams, first, ids, place = _numbered(points, starts, k)
    new_grams, new_first, new_ids, new_place = _numbered(changed, at, k)
    first, count, new_first, new_count = first[:-1], np.diff(first), new_first[:-1], np.diff(new_first)
    same = np.zeros(n, np.int64)
    same[:-1] = np.minimum(np.maximum(kept - k + 1, 0), np.minimum(count[:-1], new_count))
    # two stretches a text, unchanged and rest; empty ones are left out
    lengths = np.stack((same, count - same), 1).ravel()
    stretch = np.flatnonzero(lengths)
    begin = np.stack((first, first + same), 1).ravel()[stretch]
    rest = store.ranges(new_first + same[:-1], new_count - same[:-1])
    rest_ids, rest_place = new_ids[rest], new_place[rest]
    with_rest = np.flatnonzero(new_count - same[:-1])
    rest_begin = (np.cumsum(new_count - same[:-1]) - (new_count - same[:-1]))[with_rest]
    # the changed texts follow the others
    every = np.concatenate((grams, new_grams))
    first, count = np.concatenate((first, len(grams) + new_first)), np.concatenate((count, new_count))
    full = np.flatnonzero(count)
    out, drawn, rest_drawn = np.zeros((len(count), size), np.uint16), np.empty_like(ids), np.empty_like(rest_ids)
    for j in range(size if len(full) else 0):
        found = np.full((tuple_size, 2 * n), _END, np.uint64)
        found[:, stretch] = _least(ids, place, begin, j, tuple_size, drawn)
        new_found = np.full((tuple_size, n - 1), _END, np.uint64)
        new_found[:, with_rest] = _least(rest_ids, rest_place, rest_begin, j, tuple_size, rest_drawn)
        unchanged = found[:, ::2]
        least = np.sort(np.concatenate((
            np.concatenate((unchanged, unchanged[:, :-1]), axis=1),
            np.concatenate((found[:, 1::2], new_found), axis=1))), axis=0)[:tuple_size, full]
        out[full, j] = _tuples(least, first[full], count[full], every, j)
    return out[:n], out[n:]


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal tuples of two fingerprints, row by row."""
    return (a == b).mean(axis=-1)


def _strings(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.string())


def of_texts(array: pa.Array) -> np.ndarray:
    return signatures(*code_points(array))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``fingerprint``, hexadecimal, to ``keep``. Null texts count as empty.

    Every row is fingerprinted by itself: repeated rows, null ids and an empty table need
    nothing special, and columns outside ``keep`` are dropped.
    """
    rows = docs.select(*keep, docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "_text", SLICE_BYTES):
            found = of_texts(store.texts(batch, "_text"))
            yield pa.RecordBatch.from_arrays(
                [*(store.column(batch, k) for k in keep), _strings([as_text(s) for s in found])],
                names=[*keep, "fingerprint"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{schema}, fingerprint string")


# -- each text beside the next one ---------------------------------------------

def with_neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``(part, tail, doc_id, text)``: documents dealt by descending id, with the next one.

    A part holds a range of ids; its rows, sorted by ``(tail, doc_id DESC, text)``, are in
    order, and the ``tail`` row at its end is a copy of the first row of the next part
    that has rows (of the first part, at the very end). So each document's next one follows
    it, and each text is shuffled once, whatever the table's size.

    Bounds come from a mergeable quantile sketch of the ids; of each part only its largest
    id goes to the driver, and comes back in a join with one row per part. Rows without an
    id come last, in a part of their own. Rows of one id stay in one part, in text order.
    """
    ids, accuracy = docs.select("doc_id"), min(max(1000, 10 * parts), 1_000_000)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = np.array(sorted(set(ids.select(F.percentile_approx("doc_id", shares, accuracy)).first()[0] or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(known: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, known.to_numpy(), "left"), dtype="int32")

    last = len(cuts) + 1
    part = F.when(F.col("doc_id").isNull(), last).otherwise(part_of(F.coalesce("doc_id", F.lit(0))))
    heads = dict(ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id")).collect())
    order = sorted(heads)
    before = dict(zip(order, [order[-1:], *([p] for p in order)]))
    table = docs.sparkSession.createDataFrame(
        [(heads[p], before[p][0]) for p in order if p != last], "doc_id bigint, to int")
    rows = (docs.select(part.alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(table), "doc_id", "left")      # as many rows as parts
            .select("doc_id", "text", F.explode(F.array_compact(F.array(
                F.struct("part", F.lit(False).alias("tail")),
                F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("tail"))))))
                .alias("at"))
            .select("at.part", "at.tail", "doc_id", "text"))
    if last in heads:      # first of the rows without an id is the least text
        least = docs.where("doc_id is null").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        rows = rows.unionByName(least.select(
            F.lit(before[last][0]).alias("part"), F.lit(True).alias("tail"), F.lit(None).cast("bigint").alias("doc_id"), "text"))
    return rows


def beside_next(docs: DataFrame, make, schema: str, parts: int) -> DataFrame:
    """``make(doc_ids, texts, next texts)`` for all documents in slices of bounded size.

    ``texts`` has one row more than ``doc_ids``: the document after the last one.
    """
    dealt = (with_neighbours(docs, parts).repartitionById(parts, "part")
             .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None      # the last row so far: its next one comes with the next slice
        for batch in store.slices(batches, "text", SLICE_BYTES):
            if carried is not None:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            tail = store.column(batch, "tail").to_numpy(zero_copy_only=False)
            carried = batch.slice(len(batch) - 1)
            if len(batch) > 1:
                yield from make(store.column(batch, "doc_id"), store.texts(batch), ~tail[:-1])

    return dealt.mapInArrow(run, schema)


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def compare_edited(docs: DataFrame, parts: int) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has its last third (whole code points, rounded down) replaced by as
    many from the start of the next document in descending order of ids, or by all of it
    if it is shorter. After the smallest id comes the largest. The only document is its own
    next. Empty texts stay empty, and are like each other only.
    """

    def make(ids: pa.Array, texts: pa.Array, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        points, starts = code_points(texts)
        length = np.diff(starts)
        third = length[:-1] // 3
        kept, taken = length[:-1] - third, np.minimum(third, length[1:])
        source = np.stack((starts[:-2], starts[1:-1]), 1).ravel()
        size = np.stack((kept, taken), 1).ravel()
        edited = points[store.ranges(source, size)]
        at = np.concatenate(([0], np.cumsum(kept + taken)))
        whole, changed = signatures_beside(points, starts, edited, at, kept)
        raw = edited.tobytes()
        digest = [hashlib.sha256(raw[4 * a:4 * b].decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"))
                  .hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
        out = pa.RecordBatch.from_arrays(
            [ids.slice(0, len(digest)), pa.array(length[:-1], pa.int64()), _strings(digest),
             _strings([as_text(s) for s in whole[:-1]]), _strings([as_text(s) for s in changed]),
             pa.array(likeness(whole[:-1], changed)), pa.array(likeness(whole[:-1], whole[1:]))],
            names=[f.split()[0] for f in EDITED.split(", ")])
        yield out.filter(pa.array(wanted))

    return beside_next(docs, make, EDITED, parts)
