"""Similarity join of word n-gram sets: a prefix tree in blocks that signatures bring together.

The n-grams of a text are hashed to 64 bits and ordered by hash, the same order for every
text. That order is cut into segments, and a set is a path of segments. Two steps:

1. Routing. Two sets with a Jaccard similarity of t differ in few n-grams, so if the hash
   range is cut into more segments than that, some segment is equal in both. A set is
   filed under the hash of each of its segments. Sets that share a filed segment are
   candidates, unless the numbers of their n-grams in 64 or more parts of the hash range
   already differ by more in all than linked sets can. Connected candidates form a block. No
   linked pair is ever in two blocks.
2. Prefix tree. The sets of a block are put into a tree of segments. Pairs of tree nodes
   are walked together from the root; the overlap of two prefixes is counted once for all
   sets below them, and a pair of subtrees is left when the n-grams already known to
   differ, with those that the remaining lengths make differ, are too many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import graph, store, words

CLASS_RATIO = 1.25       # sets whose sizes lie within it are cut alike
THICK = 4                # n-grams a filed segment should hold, where sizes allow it
CUTS = 6                 # cuts tried on a set before its thin segments are filed too
BLOCK_GRAMS = 1 << 18    # n-grams of the sets in half a group
NODE_GRAMS = 8           # n-grams of a tree segment, on average
PAIRS = 1 << 18          # node pairs that are expanded at once
SLOTS = 64               # parts of the hash range whose n-grams are counted, at least;
SLOT_GRAMS = 8           # more for larger sets, so that a part has at most so many n-grams,
MOST_SLOTS = 1 << 14     # up to this many parts
RELEASED_BYTES = 1 << 18 # of a group's texts after which free memory goes back
MEMBERS = 1 << 11        # sets whose counts are compared at once


def gram_sets(array: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words than n are one n-gram."""
    codes, offsets, dictionary = words.split(array)
    hashed = words.hashes(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
    return [np.unique(words.shingles(hashed[a:b], n)) for a, b in zip(offsets, offsets[1:])]


def size_class(n: int, ratio: float = CLASS_RATIO) -> int:
    c = int(np.log(max(n, 1)) / np.log(ratio))
    while ratio ** (c + 1) <= n:
        c += 1
    while ratio ** c > n:
        c -= 1
    return c


def most_different(size: float, similarity: float) -> int:
    """N-grams in which two sets can differ at most if both have ``size`` or fewer."""
    return int(np.floor(2 * size * (1 - similarity) / (1 + similarity) + 1e-9))


@lru_cache(maxsize=4096)
def cut_rule(c: int, similarity: float) -> tuple[int, int, int]:
    """``(segments, spare, thick)`` for the sets of a class and their partners.

    Linked sets differ in ``most`` n-grams at most, so they agree on ``spare + 1`` of
    ``most + 1 + spare`` segments or more. The rule takes the largest ``thick``, then the
    smallest ``spare``, for which nine in ten sets have no more than ``spare`` segments
    with fewer than ``thick`` n-grams.
    """
    most = most_different(np.ceil(CLASS_RATIO ** (c + 1)), similarity)
    smallest = max(1.0, CLASS_RATIO ** c * similarity)
    for thick in range(THICK, 0, -1):
        for spare in range(0, most + 2, max(1, most // 40)):
            k = most + 1 + spare
            mean = smallest / k
            thin = sum(np.exp(-mean) * mean ** i / math.factorial(i) for i in range(thick))
            spread = math.sqrt(2 * k * thin * (1 - thin)) or 1.0
            if math.erfc((spare + 0.5 - k * thin) / spread) / 2 <= 0.1:
                return k, spare, thick
    return most + 1, 0, 1


def _filed(grams: np.ndarray, c: int, similarity: float) -> list[np.ndarray]:
    """Hashes of the segments of a set by the rule of class ``c``.

    Filed are the thick segments. Two linked sets that agree on thin segments only both
    have more than ``spare`` of those; such sets are cut anew, by another order of the
    n-grams, and filed under the thick segments of that cut as well, and so on. After the
    last cut all segments are filed, so that no linked pair is missed.
    """
    k, spare, thick = cut_rule(c, similarity)
    bounds, out = (np.arange(1, k) * (2.0 ** 64 / k)).astype(np.uint64), []
    for cut in range(CUTS):
        if cut:
            grams = np.sort(words.mix(grams + np.uint64(cut)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(grams), dtype=np.uint64)))
        at = np.concatenate(([0], np.searchsorted(grams, bounds), [len(grams)]))
        kept = np.diff(at) >= thick
        done = k - kept.sum() <= spare
        if not done and cut == CUTS - 1:
            kept[:] = True
        which = np.flatnonzero(kept)
        code = words.mix(which.astype(np.uint64) + np.uint64((c * CUTS + cut) << 32))
        out.append(words.mix((sums[at[which + 1]] - sums[at[which]]) * words.MULTIPLY + code))
        if done:
            break
    return out


def signatures(grams: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of the segments under which a set is filed.

    A set is cut by the rule of its own size class and, if a linked set may be in the next
    class, by the rule of that one too. Where a class is too small for two of its sets to
    be linked without being equal, nothing is filed.
    """
    out = [np.zeros(0, np.uint64)]
    for c in range(size_class(len(grams)), size_class(int(len(grams) / similarity + 1e-9)) + 1):
        if most_different(np.ceil(CLASS_RATIO ** (c + 1)), similarity):
            out += _filed(grams, c, similarity)
    return np.concatenate(out)


def slot_counts(grams: np.ndarray) -> bytes:
    """How many n-grams each part of the hash range has, up to 255.

    The counts of unrelated sets differ by about the root of n-grams times parts. With few
    parts that is less than what large linked sets may differ by, so parts grow with the set.
    """
    bits = SLOTS.bit_length() - 1
    while 1 << bits < min(MOST_SLOTS, len(grams) / SLOT_GRAMS):
        bits += 1
    at = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _signed(docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """``(doc_id, n_shingles, h1, h2, slots, sigs)`` of each text; h1 and h2 stand for its
    set, slots holds how many n-grams each part of the hash range has, up to 255. Of equal
    sets handled together one has signatures, so that copies do not pile up under them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            sets = gram_sets(store.texts(batch), n)
            has_id, seen, sigs = store.column(batch, "doc_id").is_valid().to_pylist(), set(), []
            for s, ok in zip(sets, has_id):
                first = ok and len(s) and (key := s.tobytes()) not in seen
                if first:
                    seen.add(key)
                sigs.append(signatures(s, similarity) if first else np.zeros(0, np.uint64))
            del seen
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            two = [np.array([words.mix(s + np.uint64(i)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                   for i in (1, 2)]
            slots = [slot_counts(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [store.column(batch, "doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)),
                 *map(pa.array, two), pa.array(slots, pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs).view(np.int64)))],
                names=["doc_id", "n_shingles", "h1", "h2", "slots", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: store.released(run(batches)), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, slots binary, sigs array<bigint>")


class Level:
    """One segment of all sets of a block: distinct contents, overlaps on demand."""

    def __init__(self, parts: list[np.ndarray]):
        kinds: dict[bytes, int] = {}
        self.of = np.array([kinds.setdefault(p.tobytes(), len(kinds)) for p in parts])
        contents = [np.frombuffer(k, np.uint64) for k in kinds]
        self.size = np.array([len(c) for c in contents])
        width = max(1, self.size.max(initial=0))
        # equal n-grams get equal numbers; padding differs on the two sides of a comparison
        flat, codes = np.unique(np.concatenate(contents), return_inverse=True)
        self.left = np.full((len(contents), width), -1, np.int32)
        fill = np.arange(width)[None, :] < self.size[:, None]
        self.left[fill] = codes
        self.right = np.where(fill, self.left, -2)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.where(a == b, self.size[a], 0)
        other = np.flatnonzero(a != b)
        step = max(1, (1 << 22) // self.left.shape[1] ** 2)
        for i in range(0, len(other), step):
            some = other[i:i + step]
            out[some] = (self.left[a[some]][:, :, None] == self.right[b[some]][:, None, :]).sum((1, 2))
        return out


class Tree:
    """Prefix tree of sets cut into segments of the hash range, all levels as arrays."""

    def __init__(self, sets: list[np.ndarray]):
        longest = max(map(len, sets))
        k = max(1, longest // NODE_GRAMS)
        bounds = (np.arange(1, k) * (2.0 ** 64 / k)).astype(np.uint64)
        cuts = [np.concatenate(([0], np.searchsorted(s, bounds), [len(s)])) for s in sets]
        self.levels = [Level([s[c[i]:c[i + 1]] for s, c in zip(sets, cuts)]) for i in range(k)]
        size = np.array([len(s) for s in sets])
        self.size, self.nodes = size, []
        node = np.zeros(len(sets), np.int64)
        prefix = np.zeros(len(sets), np.int64)
        for level in self.levels:
            both, node = np.unique(node * (level.of.max() + 1) + level.of, return_inverse=True)
            prefix = prefix + level.size[level.of]
            n = len(both)
            first = np.full(n, len(sets))
            np.minimum.at(first, node, np.arange(len(sets)))
            low, high = np.full(n, longest + 1), np.zeros(n, np.int64)
            np.minimum.at(low, node, size)
            np.maximum.at(high, node, size)
            self.nodes.append({"of": node, "content": level.of[first], "prefix": prefix[first],
                               "low": low, "high": high, "first": first})
        for upper, lower in zip([None, *self.nodes], self.nodes):
            up = np.zeros(len(lower["first"]), np.int64) if upper is None else upper["of"][lower["first"]]
            lower["order"] = np.argsort(up, kind="stable")
            counts = np.bincount(up, minlength=1 if upper is None else len(upper["first"]))
            lower["start"], lower["count"] = np.cumsum(counts) - counts, counts


def _prune(tree: Tree, nodes: dict, a, b, shared, similarity: float) -> np.ndarray:
    """Node pairs below which a link is still possible.

    Known differences, plus the least that the lengths left on both sides force, may not
    exceed what the largest sizes below the two nodes allow.
    """
    known = nodes["prefix"][a] + nodes["prefix"][b] - 2 * shared
    least_a, most_a = nodes["low"][a] - nodes["prefix"][a], nodes["high"][a] - nodes["prefix"][a]
    least_b, most_b = nodes["low"][b] - nodes["prefix"][b], nodes["high"][b] - nodes["prefix"][b]
    forced = np.maximum(0, np.maximum(least_a - most_b, least_b - most_a))
    allowed = (nodes["high"][a] + nodes["high"][b]) * (1 - similarity) / (1 + similarity)
    return known + forced <= allowed + 1e-9


def tree_join(sets: list[np.ndarray], side: np.ndarray | None, parts: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct sets with ``q * intersection >= p * union``, for ``parts`` (p, q).

    With ``side``, pairs on the same side may be left out.
    """
    p, q = parts
    tree = Tree(sets)
    stack = [(-1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b, shared = stack.pop()
        if depth == len(tree.levels) - 1:
            nodes = tree.nodes[depth]
            x, y = nodes["first"][a], nodes["first"][b]
            hit = (x != y) & (q * shared >= p * (tree.size[x] + tree.size[y] - shared))
            if side is not None:
                hit &= side[x] != side[y]
            yield x[hit], y[hit]
            continue
        nodes, level = tree.nodes[depth + 1], tree.levels[depth + 1]
        many = nodes["count"][a] * nodes["count"][b]
        if many.sum() > PAIRS and len(a) > 1:
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:], shared[half:]), (depth, a[:half], b[:half], shared[:half])]
            continue
        at = np.repeat(np.arange(len(a)), many)
        step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        wide = nodes["count"][b][at]
        u = nodes["order"][nodes["start"][a[at]] + step // wide]
        v = nodes["order"][nodes["start"][b[at]] + step % wide]
        once = (a[at] != b[at]) | (u <= v)
        u, v, at = u[once], v[once], at[once]
        total = shared[at] + level.overlap(nodes["content"][u], nodes["content"][v])
        kept = _prune(tree, nodes, u, v, total, p / q)
        for i in range(0, int(kept.sum()), PAIRS):
            some = np.flatnonzero(kept)[i:i + PAIRS]
            stack.append((depth + 1, u[some], v[some], total[some]))


def _reached(ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block reduced to one per set: to the smallest id it reaches there."""
    order = np.argsort(ids, kind="stable")
    parent = np.arange(len(ids))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in found:
        for x, y in zip(rank[a].tolist(), rank[b].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(ids))])
    moved = np.flatnonzero(roots != np.arange(len(ids)))
    ids = ids[order]
    return ids[moved], ids[roots[moved]]


def _blocks(docs: DataFrame, block: DataFrame) -> DataFrame:
    """Texts of the documents that have candidates, ready to be grouped. Texts are dealt
    out rather than their sets, since hashes cannot be compressed.

    A block of more than ``BLOCK_GRAMS`` n-grams is cut by hash; every two of its parts
    meet in a group of their own, so no group outgrows memory and no pair is left out.
    """
    size = block.groupBy("component").agg(F.sum("n_shingles").alias("grams"))
    block = block.join(size, "component")
    parts = F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int")
    block = block.select("doc_id", "component", parts.alias("parts")).hint("merge")   # alike at any size
    rows = docs.select("doc_id", "text").join(block, "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    rows = rows.select("doc_id", "component", "text", own.alias("own"),
                       F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("doc_id", "component", "text", F.least("own", "other").alias("low"),
                       F.greatest("own", "other").alias("high"),
                       (F.col("own") > F.col("other")).alias("side"))


def links(docs: DataFrame, block: DataFrame, n: int, parts: tuple[int, int]) -> DataFrame:
    """``(a, b)``: links that connect all linked sets of ``docs`` within ``block``."""
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        sets = gram_sets(pa.concat_arrays(group.column("text").chunks).fill_null("").cast(pa.string()), n)
        one = group.column("low")[0] == group.column("high")[0]
        side = None if one else group.column("side").to_numpy()
        a, b = _reached(ids, tree_join(sets, side, parts))
        if group.nbytes > RELEASED_BYTES:
            del sets
            store.release()
        return pa.table({"a": a, "b": b})

    return (_blocks(docs, block).groupBy("component", "low", "high")
            .applyInArrow(run, "a bigint, b bigint"))


def components(docs: DataFrame, folder: store.Folder, n: int = 3, parts: tuple[int, int] = (90, 100)) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs`` (doc_id, text).

    Two texts are linked if ``q * intersection >= p * union`` of their sets of word n-grams,
    for ``parts`` (p, q). ``component_id`` is the smallest id that a row reaches. Texts
    without words, and null ones, have empty sets and link with nothing, not even with
    each other; neither do rows with a null id. Equal sets are one while links are looked
    for. Every row is answered, repeated rows alike; rows that share an id but not a text
    are linked to each other. A set may be as long as one text; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    signed = folder.cut(_signed(rows, n, parts[0] / parts[1]), "signed")
    sets = folder.cut(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"),
             F.any_value("slots").alias("slots")), "sets")
    filed = folder.cut(_filed_sets(signed), "filed")
    signed = folder.cut(signed.select("doc_id", "n_shingles", "h1", "h2"), "known")
    folder.drop("signed")       # the signatures are the widest column by far
    edges = folder.cut(_candidates(filed, sets, folder, parts[0] / parts[1]), "edges")
    folder.drop("filed", "groups")
    near = graph.components(edges, folder, "near")
    block = near.join(sets.select(F.col("h1").alias("node"), "rep", "n_shingles"), "node").select(
        F.col("rep").alias("doc_id"), "component", "n_shingles")
    block = folder.cut(block, "blocks")
    folder.drop("edges")
    found = folder.cut(links(rows, block, n, parts), "links")
    found = found.unionByName(_shared_ids(signed, sets))
    reached = graph.components(found, folder, "reached")
    known = (sets.select("h1", "h2", F.col("rep").alias("node")).join(reached, "node", "left")
             .select("h1", "h2", F.coalesce("component", "node").alias("component_id")))
    full = F.col("n_shingles") > 0
    answered = signed.where(full & F.col("doc_id").isNotNull()).join(known, ["h1", "h2"], "left")
    alone = signed.where(~full | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id"]
    return answered.select(names).unionByName(alone.select(names))


def _filed_sets(signed: DataFrame) -> DataFrame:
    """``(sig, set, n)``: sets filed under a signature that ``n`` > 1 sets have.

    A set is named by its first hash.
    """
    one = Window.partitionBy("sig")
    before = F.lag("set").over(one.orderBy("set"))
    return (signed.select(F.col("h1").alias("set"), F.explode("sigs").alias("sig"))
            .withColumn("before", before).where("before is null or before <> set").drop("before")
            .withColumn("n", F.count("*").over(one)).where("n > 1"))


def _candidates(filed: DataFrame, sets: DataFrame, folder: store.Folder, similarity: float) -> DataFrame:
    """``(a, b)``: edges that connect all sets that may be linked.

    Sets filed under one signature are candidates of each other. They are compared by the
    counts of their slots: the differences of the counts add up to no more than the n-grams
    in which two sets differ, so a pair with a larger sum is no candidate, and the others
    are reduced to one edge per set. Groups with the same sets are compared once. A group of
    more than ``MEMBERS`` is cut by hash, and every two of its parts are compared together.
    """
    def with_slots(rows: DataFrame, *key: str) -> DataFrame:
        found = rows.join(sets.select(F.col("h1").alias("set"), "n_shingles", "slots"), "set")
        return (found.groupBy(*key).agg(F.collect_list(F.struct("set", "n_shingles", "slots")).alias("m"))
                .select(F.col("m.set").alias("rep"), F.col("m.n_shingles").alias("n"), F.col("m.slots").alias("slots")))

    groups = (filed.where(F.col("n") <= MEMBERS).groupBy("sig")
              .agg(F.array_sort(F.collect_list("set")).alias("sets")).select("sets").distinct()
              .select("sets", F.monotonically_increasing_id().alias("group")))
    groups = folder.cut(groups, "groups")
    parts = F.ceil(2 * F.col("n") / MEMBERS).cast("int")
    large = (filed.where(F.col("n") > MEMBERS).select("sig", "set", parts.alias("parts"))
             .withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("sig", "set", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    members = with_slots(groups.select("group", F.explode("sets").alias("set")), "group").unionByName(
        with_slots(large, "sig", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_near(np.array(r), np.array(n), s, similarity)
                   for r, n, s in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return members.mapInArrow(lambda batches: store.released(run(batches)), "a bigint, b bigint")


def _near(ids: np.ndarray, size: np.ndarray, slots: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the sets of a group whose slot counts may be those of linked sets.

    All are brought to the fewest slots that one of them has; pairs that pass by ``SLOTS``
    are compared by these.
    """
    fewest = min(map(len, slots))
    counts = np.stack([np.frombuffer(s, np.uint8).reshape(fewest, -1).sum(1, dtype=np.int32) for s in slots])
    coarse = counts.reshape(len(ids), SLOTS, -1).sum(2, dtype=np.int32)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(len(ids) - 1):
            apart = np.abs(coarse[i + 1:] - coarse[i]).sum(1)
            allowed = (size[i + 1:] + size[i]) * (1 - similarity) / (1 + similarity) + 1e-9
            found = np.flatnonzero(apart <= allowed)
            if fewest > SLOTS and len(found):
                found = found[np.abs(counts[found + i + 1] - counts[i]).sum(1) <= allowed[found]]
            yield np.full(len(found), i), found + i + 1

    return _reached(ids, pairs())


def _shared_ids(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the sets of rows that have one id."""
    full = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "h1", "h2")
    several = (full.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y"))
               .where("x <> y").select("doc_id"))
    ids = full.join(several, "doc_id").join(sets.select("h1", "h2", "rep"), ["h1", "h2"])
    return ids.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
