"""A file format for token ids: directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every
id that has one, a bitmap of the ids that go on, and a rank directory: the number of set
bits before each block of 512. The next chunk of an id is found by its rank, so any id, or
any range of ids, is read without decoding what lies before it.

A shard is one file: all levels, then the documents' ids and first positions, then a JSON
footer with the place of each part, then the footer's length and the magic bytes.
"""

from __future__ import annotations

import json

import numpy as np

MAGIC = b"DACTOK01"
BLOCK = 512
NULL_ID = np.iinfo(np.int64).min


def levels_of(ids: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while len(rest) or not out:
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        padded[:len(rest)] = more
        counts = padded.reshape(-1, BLOCK).sum(1)
        out.append({"chunks": (rest & 0xFF).astype(np.uint8),
                    "bitmap": np.packbits(padded, bitorder="little"),
                    "ranks": (np.cumsum(counts) - counts).astype("<u8")})
        rest = rest[more] >> np.uint32(8)
    return out


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """One shard. ``starts``: position of each document's first id within it."""
    body, footer, at = [], {"ids": len(ids), "docs": len(doc_ids), "levels": []}, 0

    def add(array: np.ndarray) -> list[int]:
        nonlocal at
        raw = array.tobytes()
        body.append(raw)
        at += len(raw)
        return [at - len(raw), len(raw)]

    for level in levels_of(ids):
        footer["levels"].append({name: add(a) for name, a in level.items()})
    footer["doc_ids"] = add(doc_ids.astype("<i8"))
    footer["starts"] = add(starts.astype("<i8"))
    tail = json.dumps(footer).encode()
    return b"".join([*body, tail, len(tail).to_bytes(8, "little"), MAGIC])


class Shard:
    """Reads a shard through ``read(position, length)``; only what is asked for is read."""

    def __init__(self, read, size: int):
        tail = read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:8], "little")
        self.read, self.footer = read, json.loads(read(size - 16 - length, length))
        self.n_ids, self.n_docs = self.footer["ids"], self.footer["docs"]

    @classmethod
    def of(cls, raw: bytes) -> Shard:
        return cls(lambda at, n: raw[at:at + n], len(raw))

    def _array(self, name: str) -> np.ndarray:
        return np.frombuffer(self.read(*self.footer[name]), "<i8")

    @property
    def doc_ids(self) -> np.ndarray:
        return self._array("doc_ids")

    @property
    def starts(self) -> np.ndarray:
        return self._array("starts")

    def _bits(self, level: dict, a: int, b: int) -> np.ndarray:
        first = a // 8
        raw = self.read(level["bitmap"][0] + first, (b + 7) // 8 - first)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[a - first * 8:b - first * 8]

    def _rank(self, level: dict, at: int) -> int:
        """Set bits before a position: the directory's entry and at most one block."""
        block = at // BLOCK
        if block * 8 >= level["ranks"][1]:      # the position after a full last block
            block -= 1
        if block < 0:
            return 0
        known = int.from_bytes(self.read(level["ranks"][0] + block * 8, 8), "little")
        return known + int(self._bits(level, block * BLOCK, at).sum())

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids at positions ``a`` to ``b - 1``."""
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        out, going, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.footer["levels"]:
            if a == b:
                break
            chunk = np.frombuffer(self.read(level["chunks"][0] + a, b - a), np.uint8)
            out[going] |= chunk.astype(np.uint32) << np.uint32(shift)
            bits = self._bits(level, a, b).astype(bool)
            a = self._rank(level, a)
            b, going, shift = a + int(bits.sum()), going[bits], shift + 8
        return out

    def __getitem__(self, at: int) -> int:
        return int(self.range(at, at + 1)[0])
