"""Near-duplicate vectors: p-stable hashing into buckets, exact cosine within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import graph, store

TABLES, PROJECTIONS, WIDTH, SEED = 64, 16, 2.0, 11
BLOCK_ROWS = 512      # vectors of a bucket that a group compares with as many others


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(rows: list[np.ndarray]) -> np.ndarray:
    """Usable vectors of one dimension at length 1, in double precision."""
    values = np.asarray(rows, np.float64)
    values = values / np.abs(values).max(1)[:, None]      # so that squares stay finite
    return values / np.sqrt((values * values).sum(1))[:, None]


def signatures(unit: np.ndarray, tables: int, projections: int, width: float,
               seed: int) -> np.ndarray:
    """A 32-bit bucket per vector and table: quantised projections, hashed together."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    planes = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    odd = rng.integers(0, 2**63, projections).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((unit @ planes + shift) / width).astype(np.int64).astype(np.uint64)
    mixed = (cells.reshape(-1, tables, projections) * odd).sum(2, dtype=np.uint64)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def hashed(vectors: DataFrame, tables: int, projections: int, width: float,
           seed: int) -> DataFrame:
    """``(rep, label, dim, embedding, copies, sigs)`` of usable ``vectors``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(store.column(batch, "embedding"))
            for dim in pc.unique(dims):
                some = batch.filter(pc.equal(dims, dim))
                flat = store.column(some, "embedding").flatten().to_numpy(zero_copy_only=False)
                sigs = signatures(units(flat.reshape(len(some), -1)), tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, dims.filter(pc.equal(dims, dim)).cast(pa.int32()),
                     pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, tables, dtype=np.int32),
                                              pa.array(sigs.ravel()))],
                    names=[*some.schema.names, "dim", "sigs"])

    rows = vectors.select("rep", "label", "embedding", "copies")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, dim int, sigs array<int>")


def pairs(unit: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, least: float,
          table: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, both ways, that no table before ``table`` has in one bucket.

    With ``side`` only pairs across the two sides count.
    """
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(near)
    new = ~(sigs[a, :table] == sigs[b, :table]).any(1) if len(a) and table else np.ones(len(a), bool)
    return a[new], b[new]


def smallest_reached(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest ``rep`` that each one reaches over the given pairs."""
    label = rep.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        if (low == label).all():
            return label
        label = low


def links(vectors: DataFrame, least: float, folder: store.Folder,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(rep, linked, to)`` per bucket: copies linked to a vector, smallest rep reached.

    A bucket is (label, dimension, table, hash). One of more than ``block_rows`` vectors is
    cut into blocks by hash and every two blocks are compared by a group of their own. So
    a group has about ``2 * block_rows`` rows at most, and no pair is left out or emitted.
    """
    key = ["label", "dim", "table", "bucket"]
    each = vectors.select("rep", "label", "dim", F.posexplode("sigs").alias("table", "bucket"))
    sizes = each.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    held = each.join(sizes.select(*key, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), key)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    held = held.select("rep", *key, own.alias("own"),
                       F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = folder.cut(held.select("rep", *key, F.least("own", "other").alias("low"),
                                  F.greatest("own", "other").alias("high"),
                                  (F.col("own") > F.col("other")).alias("side")), "buckets")
    held = held.join(vectors.select("rep", "embedding", "sigs", "copies"), "rep")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        unit = units(group.column("embedding").to_numpy().tolist())
        sigs = np.asarray(group.column("sigs").to_numpy().tolist(), np.int32)
        one = group.column("low")[0] == group.column("high")[0]
        side = None if one else group.column("side").to_numpy()
        a, b = pairs(unit, sigs, side, least, group.column("table")[0].as_py())
        linked = np.bincount(a, weights=copies[b], minlength=len(rep)).astype(np.int64)
        used = np.flatnonzero(linked)
        return pa.table({"rep": rep[used], "linked": linked[used],
                         "to": smallest_reached(rep, a, b)[used]})

    return held.groupBy(*key, "low", "high").applyInArrow(run, "rep bigint, linked bigint, to bigint")


def near_duplicates(vectors: DataFrame, folder: store.Folder, least: float = 0.93,
                    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
                    seed: int = SEED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors``.

    Vectors ``(vec_id, embedding, label)`` of equal labels and dimensions are linked if
    their cosine, in double precision, is ``least`` or more. Unit vectors with that cosine
    are at most sqrt(2 - 2 least) apart, which is what the hashing is laid out for: with
    the defaults, a pair at exactly 0.93 shares a bucket with probability 0.99, a closer
    one with more; unrelated ones share one in a thousand. For far larger labels raise
    ``projections`` with the logarithm of their size, and ``tables`` to keep that recall.

    Exact copies are one vector while hashing and count as links of each other. Vectors
    that are null, empty, zero, or hold a null or non-finite component, and rows with a null
    label or id, link with nothing. Rows that share an id but not a vector: the smallest
    vector is compared, the others link with their copies only. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    distinct = folder.cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    one = distinct.groupBy("rep").agg(F.min(F.struct("label", "embedding", "copies")).alias("v")).select("rep", "v.*")
    ready = folder.cut(hashed(one, tables, projections, width, seed), "hashed")
    found = folder.cut(links(ready, least, folder), "links")
    reached = graph.components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), folder, "graph")
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    known = (distinct.join(counts, "rep", "left")
             .join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    fits = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    answered = (good.join(known, ["label", "embedding"], "left")
                .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                        F.coalesce("component_id", "vec_id").alias("component_id")))
    alone = (rows.where(~(fits & F.col("label").isNotNull()))
             .select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return answered.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
