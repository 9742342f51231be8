"""Words of many texts as arrays: one code per word, one hash per distinct word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def split(array: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: codes of all words, their text's offsets, dictionary.

    ``A``-``Z`` become lower case, nothing else changes. A text without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(array)))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    blank = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if blank.any():                      # an empty text splits into one empty word
        before = np.concatenate(([0], np.cumsum(blank)))
        codes, offsets = codes[~blank], offsets - before[offsets]
    return codes, offsets, coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def shingles(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; fewer words make one run of them all."""
    n = min(n, len(hashed))
    if not n:
        return np.zeros(0, np.uint64)
    out = hashed[:len(hashed) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * MULTIPLY + hashed[i:len(hashed) - n + 1 + i])
    return mix(out + np.uint64(n))
