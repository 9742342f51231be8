"""Ranked lexical search over blocked posting lists, exact.

Documents are indexed in segments of bounded size. In a segment each term has a posting
list, and each list is cut geometrically: its documents are assigned to the nearest of a
few of them (cosine of projected term vectors), so that a block holds similar documents.
A block keeps a summary, the coordinatewise maximum of its documents' term values. The
weighted sum of a summary over a query's terms bounds every score in the block. Blocks are
opened from the highest bound down, until the bounds fall below the query's k-th best
score so far; nothing else is skipped, so the result is that of scoring everything.

Queries are taken in batches with a bounded number of terms. A batch's terms are the
index's vocabulary: one pass over the texts gives term counts, statistics of the whole
table follow from them, and the index is made and searched from the counts, segment by segment. Values,
weights and scores are 64-bit integers, so no result depends on an order of additions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import store
from .store import Folder

BATCH_TERMS = 16_384        # distinct terms of a batch of queries; one query may have more
SEGMENT_CELLS = 1 << 23     # documents of a segment times terms of the batch
SEGMENT_PAIRS = 1 << 26     # pairs of terms within its documents: bounds its summaries
BLOCK_DOCS = 64             # documents a block has on average
PROJECTED = 24              # dimensions that similarity is measured in
OPENED = 16                 # blocks opened at first, twice as many each time

COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
# Bytes of a term are ASCII letters and digits and all bytes of other
# characters; A-Z count as a-z.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after the other, and where each text's start."""
    data, offsets = store.text_bytes(array)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    opens = inside[1:-1] & ~inside[:-2]
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True     # no term reaches into the next text
    opens &= inside[1:-1]
    kept = np.flatnonzero(inside[1:-1])
    first = np.flatnonzero(opens[kept])
    at = np.append(first, len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [
        None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[kept]])])
    return found, np.searchsorted(kept[first], offsets)


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each document with a term at all.

    ``n`` counts all its terms, ``terms`` are those of ``vocabulary`` (a broadcast list of
    sorted terms), by place.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.binary())
        size = max(1, len(known))
        for batch in store.slices(batches):
            found, starts = terms(store.texts(batch))
            coded = found.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            code = place[coded.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(starts))
            asked = code >= 0
            pair, tf = np.unique(doc[asked] * size + code[asked], return_counts=True)
            at = np.searchsorted(pair, np.arange(len(batch) + 1, dtype=np.int64) * size)
            offsets = pa.array(at, pa.int32())
            n = np.diff(starts)
            out = pa.RecordBatch.from_arrays(
                [store.column(batch, "doc_id"), pa.array(n),
                 pa.ListArray.from_arrays(offsets, pa.array(pair % size, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(run, COUNTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def values(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's value in a document of ``n`` terms; below 1,000,000."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# -- index ----------------------------------------------------------------------

def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    held = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return held.to_numpy(zero_copy_only=False), offsets - offsets[0]


def blocks_of(near: np.ndarray, per_block: int = BLOCK_DOCS) -> np.ndarray:
    """Block of each document of a list, by the nearest of a few documents of the list."""
    n = -(-len(near) // per_block)
    if n == 1:
        return np.zeros(len(near), np.int64)
    centres = near[np.linspace(0, len(near) - 1, n).astype(np.int64)]
    return np.argmax(near @ centres.T, axis=1)


def segment(doc_ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, value: np.ndarray,
            asked: list[np.ndarray], weights: np.ndarray, per_block: int = BLOCK_DOCS) -> dict:
    """Posting lists of some documents, in blocks with summaries.

    ``asked[t]`` are the terms that occur in a query beside term t. A list is opened by
    queries that hold its term only, so its summaries keep those coordinates. Terms of
    weight 0 add nothing to a score and have no list.
    """
    n, size = len(doc_ids), len(asked)
    doc = np.repeat(np.arange(n), np.diff(starts))
    cells = np.zeros((n, size), np.int32)
    cells[doc, codes] = value
    draw = np.random.default_rng(12).standard_normal((size, PROJECTED), np.float32)
    draw *= weights[:, None].astype(np.float32)
    near = np.concatenate([cells[a:a + 256].astype(np.float32) @ draw for a in range(0, n, 256)] or [
        np.zeros((0, PROJECTED), np.float32)])
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[by_term], np.arange(size + 1))
    posted = doc[by_term]
    lists, block_starts, block_docs = [0], [np.zeros(1, np.int64)], []
    sizes, at, maxima, filled = [], [], [], 0
    for t in range(size):
        listed = posted[edges[t]:edges[t + 1]]
        if not len(listed) or not weights[t]:
            lists.append(lists[-1])
            continue
        block = blocks_of(near[listed], per_block)
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.diff(block[order], prepend=-1))
        listed = listed[order]
        most = np.maximum.reduceat(cells[listed[:, None], asked[t]], first, axis=0)
        b, c = np.nonzero(most)
        sizes.append(np.bincount(b, minlength=len(first)))
        at.append(asked[t][c].astype(np.int32))
        maxima.append(most[b, c])
        block_docs.append(listed)
        block_starts.append(filled + np.append(first[1:], len(listed)))
        filled += len(listed)
        lists.append(lists[-1] + len(first))

    def joined(parts):
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return {"doc_ids": doc_ids, "starts": starts, "terms": codes, "values": value, "lists": np.array(lists),
            "block_starts": joined(block_starts), "block_docs": joined(block_docs),
            "summary_starts": np.concatenate(([0], np.cumsum(joined(sizes)))),
            "summary_terms": joined(at), "summary_values": joined(maxima)}


def terms_beside(queries: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each term, the terms of all queries that hold it; equal answers are one array."""
    holders: list[list[int]] = [[] for _ in range(size)]
    for q, query in enumerate(queries):
        for t in query.tolist():
            holders[t].append(q)
    known: dict[tuple, np.ndarray] = {(): np.zeros(0, np.int64)}
    for h in map(tuple, holders):
        if h not in known:
            known[h] = np.unique(np.concatenate([queries[q] for q in h]))
    return [known[tuple(h)] for h in holders]


NO_ID = np.iinfo(np.int64).max      # stands for a null id, which comes last among equal scores


def segments(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, asked: list[np.ndarray],
             weights: np.ndarray) -> Iterator[dict]:
    """Counted documents as segments of bounded size, one document at least."""
    n_rows = max(1, SEGMENT_CELLS // max(1, len(weights)))

    def made(rows: list[pa.RecordBatch]) -> dict:
        rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        codes, starts = _flat(store.column(rows, "terms"))
        tf, _ = _flat(store.column(rows, "tfs"))
        n = np.repeat(store.column(rows, "n").to_numpy(), np.diff(starts))
        ids = store.column(rows, "doc_id").fill_null(int(NO_ID)).to_numpy()
        return segment(ids, starts, codes.astype(np.int64), values(tf.astype(np.int64), n, n_docs, n_terms),
                       asked, weights)

    held, n, pairs = [], 0, 0
    for batch in batches:
        load = np.diff(_flat(store.column(batch, "terms"))[1]) ** 2
        start = 0
        for i, more in enumerate(load.tolist()):
            if n and (n == n_rows or pairs + more > SEGMENT_PAIRS):
                held.append(batch.slice(start, i - start))
                yield made(held)
                held, n, pairs, start = [], 0, 0, i
            n, pairs = n + 1, pairs + more
        held.append(batch.slice(start))
    if n:
        yield made(held)


# -- search ---------------------------------------------------------------------

class Searcher:
    """A segment, opened for queries. ``opened`` and ``blocks`` count its work."""

    def __init__(self, columns: dict[str, np.ndarray], n_terms: int):
        self.__dict__.update(columns)
        self.weight = np.zeros(n_terms, np.int64)
        self.opened = self.blocks = 0

    def _sums(self, starts: np.ndarray, of: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Weighted sums of the sparse rows ``of``; each has an entry at least."""
        size = starts[of + 1] - starts[of]
        cell = store.ranges(starts[of], size)
        return np.add.reduceat(self.weight[at[cell]] * value[cell], np.cumsum(size) - size)

    def best(self, query: np.ndarray, weights: np.ndarray, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best of ``found`` and of this segment, as ``(-score, doc_id)`` in order."""
        blocks = store.ranges(self.lists[query], self.lists[query + 1] - self.lists[query])
        self.blocks += len(blocks)
        if not len(blocks):
            return found
        self.weight[query] = weights
        bound = self._sums(self.summary_starts, blocks, self.summary_terms, self.summary_values)
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        seen, at, step = np.zeros(len(self.doc_ids), bool), 0, OPENED
        while at < len(blocks):
            least = -found[-1][0] if len(found) == k else 1
            end = at + int(np.searchsorted(-bound[at:at + step], -least, "right"))
            if end == at:       # every block left is bounded below the k-th best
                break
            some = blocks[at:end]
            docs = self.block_docs[store.ranges(self.block_starts[some], np.diff(self.block_starts)[some])]
            docs = np.unique(docs)
            docs = docs[~seen[docs]]
            seen[docs] = True
            self.opened += end - at
            if len(docs):
                score = self._sums(self.starts, docs, self.terms, self.values)
                good = np.flatnonzero(score >= least)
                if len(good) > k:       # equal scores are all kept for the comparison of ids
                    good = good[score[good] >= -np.partition(-score[good], k - 1)[k - 1]]
                more = zip((-score[good]).tolist(), self.doc_ids[docs[good]].tolist())
                found = sorted([*found, *more])[:k]
            at, step = end, 2 * step
        self.weight[query] = 0
        return found


def best_of_tasks(counts: DataFrame, n_docs: int, n_terms: int, queries, weights: np.ndarray,
                  k: int) -> DataFrame:
    """``(query, doc_id, score)``: of each task the k best of each query at most.

    A task makes its documents' segments one after the other and searches each with all
    queries of the batch; the k best scores so far bound what it opens in the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = terms_beside(queries.value, len(weights))
        found: dict[int, list] = {}
        for made in segments(batches, n_docs, n_terms, asked, weights):
            searcher = Searcher(made, len(weights))
            for q, query in enumerate(queries.value):
                found[q] = searcher.best(query, weights[query], k, found.get(q, []))
        flat = [(q, d, -s) for q, rows in found.items() for s, d in rows]
        query, doc, score = zip(*flat) if flat else ((), (), ())
        doc = np.array(doc, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(doc, mask=doc == NO_ID), pa.array(score, pa.int64())],
            names=["query", "doc_id", "score"])

    return (counts.where(F.size("terms") > 0)
            .mapInArrow(run, "query int, doc_id bigint, score bigint"))


def batches_of(items: DataFrame, batch_terms: int = BATCH_TERMS) -> Iterator[tuple[list, list[list[bytes]]]]:
    """``(item ids, their distinct terms)`` in batches with few terms, one item at least.

    Items come to the driver partition by partition, a batch at a time.
    """
    ids, held, known = [], [], set()
    for item_id, text in items.toLocalIterator():
        found = sorted(set(terms(pa.array([text or ""]))[0].to_pylist()))
        if held and len(known.union(found)) > batch_terms:
            yield ids, held
            ids, held, known = [], [], set()
        ids.append(item_id)
        held.append(found)
        known.update(found)
    if held:
        yield ids, held


def search(docs: DataFrame, items: DataFrame, folder: Folder, k: int = 10,
           batch_terms: int = BATCH_TERMS) -> DataFrame:
    """The k highest-scoring documents of each item: ``(item_id, rank, doc_id, score)``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` have ``item_id`` and ``text``; other
    columns are not looked at. Equal scores rank by ascending id, a null id last; scores
    of 0 are left out, so an item may have fewer rows or none. Null and empty texts hold no
    term and are not counted. Repeated documents are each ranked; repeated items (id and
    text) give their rows once. A document of any length has one vector.
    """
    spark, out = docs.sparkSession, None
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    for number, (ids, texts) in enumerate(batches_of(items, batch_terms)):
        part = _batch(spark, docs, ids, texts, k, folder, number)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def _batch(spark: SparkSession, docs: DataFrame, ids: list, texts: list[list[bytes]], k: int,
           folder: Folder, number: int) -> DataFrame:
    """A batch's written result. What was broadcast or written for it alone is given up."""
    share = spark.sparkContext.broadcast
    vocabulary = share(sorted({t for text in texts for t in text}))
    counts = folder.cut(count_terms(docs, vocabulary), f"counts-{number}")
    total = counts.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    df = np.zeros(len(vocabulary.value), np.int64)      # bounded by the batch
    for row in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[row["t"]] = row["count"]
    weights = np.array([weight(total["n_docs"], int(d)) for d in df], np.int64)
    place = {t: i for i, t in enumerate(vocabulary.value)}
    queries = share([np.array([place[t] for t in text], np.int64) for text in texts])
    names = spark.createDataFrame(list(enumerate(ids)), "query int, item_id bigint")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = (best_of_tasks(counts, total["n_docs"], total["n_terms"] or 1, queries, weights, k)
             .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .join(F.broadcast(names), "query")      # as many rows as items of the batch
             .select("item_id", "rank", "doc_id", "score"))
    found = folder.cut(found, f"found-{number}")
    folder.drop(f"counts-{number}")
    vocabulary.destroy()
    queries.destroy()
    return found
