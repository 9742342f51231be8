"""Helpers for folds over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of each run of rows with equal values in ``columns``."""
    n = len(batch)
    if not n:
        return
    change = np.zeros(n - 1, bool)
    for i in columns:
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change |= codes[1:] != codes[:-1]
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    yield from zip(bounds, bounds[1:])
