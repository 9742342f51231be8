"""Token-id output: documents to shards of directly addressable codes, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe, dac, store

SHARD_IDS = 8_000_000
SLICE_BYTES = 2 << 20      # text encoded at once, beside the ids a task holds for its shard
READ_IDS = 1 << 18         # ids of neighbouring documents read at once, or one document's
MANIFEST = "part int, shard int, path string, n_ids bigint, n_docs bigint"


def write(docs: DataFrame, folder: store.Folder, path: str, end_id: int | None = 0,
          pattern: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the ids of all texts in ascending ``doc_id`` order; returns the manifest.

    Documents are range-partitioned by id, so shards in the order of (part, shard) hold
    them in order. ``first`` is the position of a shard's first id among all ids. Each
    text's ids end with ``end_id``. A null text is empty; null ids come first; rows with
    equal ids are ordered by their text and all kept. An empty table gives an empty
    manifest. A shard is closed at ``shard_ids`` ids, a longer document stays whole.

    A task writes files under its attempt's own name and reports them; a lost attempt's
    files are in no manifest.
    """
    order = F.xxhash64("text")
    rows = (docs.select("doc_id", F.col("text"), order.alias("_tie"))
            .repartitionByRange("doc_id", "_tie")
            .sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text"))
    target = folder.files("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        use, part = bpe.encoder(path, pattern), TaskContext.get().partitionId()
        fs, inside = store.filesystem(target)
        fs.create_dir(inside, recursive=True)
        held, held_ids, n, shard = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, held_ids, n, shard
            name = f"{store.attempt_name()}-{shard:05d}.dac"
            counts = np.concatenate([c for _, c in held])
            raw = dac.pack(np.concatenate(held_ids), np.concatenate([d for d, _ in held]),
                           np.cumsum(counts) - counts)
            with fs.open_output_stream(f"{inside}/{name}") as out:
                out.write(raw)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "path": [f"{target}/{name}"], "n_ids": [n], "n_docs": [len(counts)]})
            held, held_ids, n, shard = [], [], 0, shard + 1
            return row

        for batch in store.slices(batches, limit=SLICE_BYTES):
            ids, starts = use.encode(store.texts(batch))
            counts = np.diff(starts)
            if end_id is not None:
                ids = np.insert(ids, starts[1:], end_id)
                counts = counts + 1
            doc_ids = store.column(batch, "doc_id").cast(pa.int64()).fill_null(dac.NULL_ID)
            held.append((doc_ids.to_numpy(zero_copy_only=False), counts))
            held_ids.append(ids)
            n += len(ids)
            if n >= shard_ids:
                yield close()
        if held:
            yield close()

    manifest = folder.cut(rows.mapInArrow(run, MANIFEST), "manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("size"))   # a row per task
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (manifest.join(parts, "part")
            .withColumn("first", F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .drop("before"))


def read(manifest: DataFrame, digest=None, kind: str = "binary") -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the shards of a manifest.

    ``start`` counts the ids of all documents before. ``digest`` may turn a document's
    ids (numpy, unsigned 32-bit) into a value of the SQL type ``kind`` in the task; without
    it ``ids`` holds them as little-endian binary. Ids are read by position, those of
    neighbouring documents together.
    """
    make = digest or (lambda ids: ids.astype("<u4").tobytes())
    arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(store.column(batch, "path").to_pylist(),
                                   store.column(batch, "first").to_pylist()):
                fs, inside = store.filesystem(name)
                with fs.open_input_file(inside) as file:
                    shard = dac.Shard(lambda at, n: file.read_at(n, at), file.size())
                    doc_ids, starts = shard.doc_ids, shard.starts
                    ends = np.append(starts[1:], shard.n_ids)
                    z = 0
                    while z < len(doc_ids):
                        a, z = z, min(z + 1000, max(z + 1, int(np.searchsorted(ends, starts[z] + READ_IDS, "right"))))
                        some = slice(a, z)
                        found = shard.range(int(starts[a]), int(ends[z - 1]))
                        values = [make(found[s:e]) for s, e in zip((starts[some] - starts[a]).tolist(),
                                                                   (ends[some] - starts[a]).tolist())]
                        known = doc_ids[some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(known, mask=known == dac.NULL_ID),
                             pa.array(starts[some] + first), pa.array(ends[some] - starts[some]),
                             pa.array(values, arrow)],
                            names=["doc_id", "start", "n_tokens", "ids"])

    return (store.spread(manifest.select("path", "first"))
            .mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids {kind}"))
