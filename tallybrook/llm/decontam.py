"""Benchmark decontamination: SimHash of item-sized windows, then exact shingle similarity.

A window has as many words as a benchmark item. Its fingerprint is the 64-bit SimHash of
its word shingles. Fingerprints are cut into blocks: two that differ in at most ``RADIUS``
bits differ in at most ``RADIUS / BLOCKS`` bits of some block, so an index of each block's
close values gives every item within the radius. Those are verified by the weighted
Jaccard similarity of the shingles, a shingle's weight being how often it occurs.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import store, words

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8           # bits; blocks of eight bits
ITEM_BATCH, ITEM_CHARS = 20_000, 16 << 20    # items that one pass over the documents takes
FILTER_BITS = 22
MARKS = string.punctuation + "¡¿«»“”„‘’‚…–—"
FOUND = "item_id bigint, similarity double, first_word bigint, n_words bigint"

_CLOSE = np.array([[v for v in range(256) if (v ^ x).bit_count() <= RADIUS // BLOCKS] for x in range(256)])


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, lower-cased and without marks around it; each text's offsets.

    Words of marks only are left out.
    """
    codes, offsets, vocabulary = words.split(pc.utf8_lower(array))
    bare = pc.utf8_trim(vocabulary, MARKS)
    blank = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    hashed = words.hashes(bare)
    if blank.any():
        gone = blank[codes]
        before = np.concatenate(([0], np.cumsum(gone)))
        codes, offsets = codes[~gone], offsets - before[offsets]
    return (hashed[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def _bits(grams: np.ndarray) -> np.ndarray:
    """64 columns of -1 and 1 for each shingle."""
    return np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash, as eight bytes, of the windows of ``size`` shingles at ``starts``."""
    low, high = starts.min(), starts.max() + size
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(grams[low:high]), axis=0, dtype=np.int32)))
    return np.packbits(total[starts - low + size] - total[starts - low] > 0, axis=1)


class Items:
    """Items of one length: their shingles with weights, and the block index."""

    def __init__(self, n_words: int):
        self.n_words, self.shingle = n_words, min(SHINGLE, n_words)
        self.size = n_words - self.shingle + 1
        self.ids: list = []
        self.grams: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.prints: list[np.ndarray] = []

    def add(self, item_id, hashed: np.ndarray) -> None:
        grams = words.shingles(hashed, SHINGLE)
        self.ids.append(item_id)
        self.prints.append(fingerprints(grams, np.zeros(1, np.int64), len(grams))[0])
        distinct, weight = np.unique(grams, return_counts=True)
        self.grams.append(distinct)
        self.weights.append(weight)

    def close(self) -> None:
        self.prints = np.array(self.prints)
        self.index = []
        for block in range(BLOCKS):
            value = _CLOSE[self.prints[:, block]]
            order = np.argsort(value.ravel(), kind="stable")
            count = np.bincount(value.ravel(), minlength=256)
            self.index.append((order // value.shape[1], np.cumsum(count) - count, count))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius, found through the blocks."""
        found = []
        for block, (item, start, count) in enumerate(self.index):
            value = prints[:, block]
            window = np.repeat(np.arange(len(prints)), count[value])
            found.append(window * len(self.ids) + item[store.ranges(start[value], count[value])])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1, dtype=np.int64)
        return window[apart <= RADIUS], item[apart <= RADIUS]

    def similarity(self, item: int, grams: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and the shingles of a window."""
        own, weight = self.grams[item], self.weights[item]
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        counts = np.bincount(at[own[at] == grams], minlength=len(own))
        shared = int(np.minimum(counts, weight).sum())
        return shared / (len(grams) + int(weight.sum()) - shared)


class Matcher:
    """A batch of benchmark items, against which texts are held."""

    def __init__(self, items: list[tuple]):
        hashed, offsets = word_hashes(pa.array([t or "" for _, t in items], pa.string()))
        lengths: dict[int, Items] = {}
        for i, (item_id, _) in enumerate(items):
            own = hashed[offsets[i]:offsets[i + 1]]
            if len(own):
                lengths.setdefault(len(own), Items(len(own))).add(item_id, own)
        self.lengths = [lengths[n] for n in sorted(lengths)]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {i.shingle for i in self.lengths}:
            grams = np.unique(np.concatenate([g for i in self.lengths if i.shingle == n for g in i.grams]))
            spot = np.zeros(1 << FILTER_BITS, bool)
            spot[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.known[n] = grams, spot
        for i in self.lengths:
            i.close()

    def matches(self, array: pa.Array, similarity: float = SIMILARITY) -> list[tuple]:
        """``(text, item id, best similarity, first word, words)`` of all matches.

        A window can only reach the similarity if that share of its shingles occurs in the
        benchmark, so other windows get no fingerprint. A text shorter than an item is one
        window. Of equally similar windows the first is reported.
        """
        hashed, offsets = word_hashes(array)
        out = []
        for n, (grams, spot) in self.known.items():
            if len(hashed) < n:
                continue
            all_grams = words.shingles(hashed, n)
            near = np.flatnonzero(spot[(all_grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(grams, all_grams[near]), len(grams) - 1)
            near = near[grams[at] == all_grams[near]]
            lengths = [i for i in self.lengths if i.shingle == n]
            fewest = min(i.size for i in lengths) * similarity - 1e-9
            bounds = np.searchsorted(near, offsets)
            for text in np.flatnonzero(np.diff(bounds) >= fewest):
                first, last = offsets[text], offsets[text + 1] - n + 1
                own = near[bounds[text]:bounds[text + 1]]
                own = own[own < last] - first
                if len(own) < fewest:
                    continue
                out += self._text(int(text), all_grams[first:last], own, lengths, similarity)
        return out

    def _text(self, text: int, grams: np.ndarray, known: np.ndarray, lengths: list[Items],
              similarity: float) -> list[tuple]:
        hit = np.zeros(len(grams) + 1, np.int64)
        hit[known + 1] = 1
        upto, found = np.cumsum(hit), []
        for items in lengths:
            size = min(items.size, len(grams))
            if size < similarity * items.size - 1e-9:
                continue
            starts = np.flatnonzero(upto[size:] - upto[:len(upto) - size] >= similarity * size - 1e-9)
            if not len(starts):
                continue
            window, item = items.candidates(fingerprints(grams, starts, size))
            best: dict[int, tuple] = {}
            for w, i in zip(window.tolist(), item.tolist()):
                start = int(starts[w])
                s = items.similarity(i, grams[start:start + size])
                if s >= similarity - 1e-12 and (i not in best or (s, -start) > best[i]):
                    best[i] = s, -start
            found += [(text, items.ids[i], s, -at, size + items.shingle - 1) for i, (s, at) in best.items()]
        return found


def _matchers(benchmark: DataFrame) -> Iterator[Matcher]:
    """The benchmark in batches of bounded size, one after the other."""
    held, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        chars += len(row["text"] or "")
        if len(held) == ITEM_BATCH or chars >= ITEM_CHARS:
            yield Matcher(held)
            held, chars = [], 0
    if held:
        yield Matcher(held)


def _passes(benchmark: DataFrame) -> Iterator[tuple[Matcher, bool]]:
    """Each batch of the benchmark, with whether it is the last."""
    batches = _matchers(benchmark)
    held = next(batches, None)
    while held is not None:
        after = next(batches, None)
        yield held, after is None
        held = after


def _search_pass(rows: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            found = shared.value.matches(store.texts(batch), similarity)
            if found:
                text, item, value, first, n = map(list, zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [store.column(batch, "doc_id").take(pa.array(text)), pa.array(item, pa.int64()),
                     pa.array(value, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return rows.mapInArrow(run, f"doc_id bigint, {FOUND}")


def search(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: texts that contain an item.

    A text contains an item ``(item_id, text)`` if a window of as many words as the item
    has a weighted similarity of five-word shingles of ``similarity`` or more; the best
    window is reported. An item or text of fewer than five words is one shingle. Words are
    lower-cased and stripped of marks. Null, empty and mark-only texts and items match
    nothing. Equal items are each reported; repeated documents and items give repeated
    rows. Other columns are ignored.

    A benchmark of any size is taken in batches, each one pass over the documents. What a
    pass finds is written and its broadcast let go before the next, so executors hold the
    items of one batch; the last pass is left to the reader of the result.
    """
    context, folder = docs.sparkSession.sparkContext, store.Folder(docs.sparkSession, "decontam")
    rows, parts = docs.select("doc_id", "text"), []
    for matcher, last in _passes(benchmark):
        shared = context.broadcast(matcher)      # ITEM_BATCH items, ITEM_CHARS characters
        found = _search_pass(rows, shared, similarity)
        if not last:
            found = folder.cut(found, f"found{len(parts)}")
            shared.destroy(blocking=True)
        parts.append(found)
    if not parts:
        return rows.limit(0).select("doc_id", *(F.lit(None).cast(k).alias(n) for n, k in
                                                (f.split() for f in FOUND.split(", "))))
    return reduce(DataFrame.unionByName, parts)


def _clean_pass(docs: DataFrame, shared: Broadcast, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            kept = np.ones(len(batch), bool)
            kept[[m[0] for m in shared.value.matches(store.texts(batch), similarity)]] = False
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that contain no item of the benchmark, with all their columns.

    As in ``search`` one batch of items is broadcast at a time. What a pass but the last
    keeps is written, and the table before it removed.
    """
    context, folder = docs.sparkSession.sparkContext, store.Folder(docs.sparkSession, "decontam")
    for i, (matcher, last) in enumerate(_passes(benchmark)):
        shared = context.broadcast(matcher)
        docs = _clean_pass(docs, shared, similarity)
        if not last:
            docs = folder.cut(docs, f"kept{i}")
            shared.destroy(blocking=True)
            if i:
                folder.drop(f"kept{i - 1}")
    return docs
