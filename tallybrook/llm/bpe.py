"""Byte-level BPE over Arrow batches with the tokenizers library, and its way back.

Text between two safe cuts is called a piece here. A cut is safe before a single space
that stands between two characters that are certainly no white space: the split patterns
of byte-level tokenizers attach such a space to what follows, and no match reaches over
it. A cut is safe between a letter and a mark or line end as well, as a run of letters ends
there in all of them, and what follows it does not look back; so a word is one piece, whatever
stands after it. So the ids of a text are those of its pieces, one after the other, and a piece
that occurs often is given to the library once. Doubtful characters are never cut at.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import store

KNOWN_PIECES = 300_000     # pieces whose ids a process remembers, and their bytes;
KNOWN_BYTES = 6 << 20      # beyond either it keeps the half seen most
MARKS = "\n,.:;!?"          # what ends a word, where no special token holds it
JOINED_BYTES = 1 << 10     # pieces handed to the library as one text
SLICE_BYTES = 2 << 20      # text encoded at once


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Bytes that print as one character stand for themselves, the others follow from
    U+0100 on in ascending order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(free)) for b in range(256)]


def byte_table(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id: the byte-to-character map, reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table[i] = (bytes(back[c] for c in token) if all(c in back for c in token)
                    else token.encode())
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each longer token is merged from, in rank order."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1),
                       key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


def tokenizer_from_file(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizer that gives the ids of a rank file: whole tokens first, then merges."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    ranks, chars = read_ranks(path), byte_characters()

    def named(token: bytes) -> str:
        return "".join(chars[b] for b in token)

    tokenizer = Tokenizer(models.BPE(
        vocab={named(t): r for t, r in ranks.items()},
        merges=[(named(a), named(b)) for a, b in merges_of(ranks)], ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before ``at`` is certainly no white space."""
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    return ((last > 32) & (last < 127)) | ((last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))


def _solid_from(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    first = data[at]
    return ((first > 32) & (first < 127)) | ((first >= 0xC3) & (first <= 0xDF))


def _letter_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before ``at`` is certainly a letter: A to Z, or U+00C0 to U+00FF."""
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    plain = ((last | 32) >= 97) & ((last | 32) <= 122)
    return plain | ((lead == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7))


class Encoder:
    """Ids of texts by a byte-level tokenizer."""

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core; threads of its own hold memory
        self.tokenizer = tokenizer
        special = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.marks = np.isin(np.arange(256), [ord(c) for c in MARKS if c not in special])
        self.table = byte_table(tokenizer.get_vocab())
        self.widths = np.array([len(b) for b in self.table], np.int64)
        self.known = pa.array([], pa.binary())
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.seen = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that came in most slices, in half the room; one slice is not enough."""
        order = np.argsort(-self.seen, kind="stable")[:KNOWN_PIECES // 2]
        size = np.asarray(pc.binary_length(self.known), np.int64)[order] + 4      # with its offset
        kept = order[(self.seen[order] > 1) & (np.cumsum(size) <= KNOWN_BYTES // 2)]
        self.ids = self.ids[store.ranges(self.starts[kept], self.counts[kept])]
        self.known, self.counts, self.seen = self.known.take(pa.array(kept)), self.counts[kept], self.seen[kept] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in found]
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32),
                np.array([len(i) for i in ids], np.int64))

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Asks for the ids of new pieces and returns their places among the known.

        Pieces that start and end solidly are joined to long texts, and so are those that start
        with a mark and end with a letter; between two of a kind the cut is safe.
        """
        data, offsets = store.text_bytes(pieces)
        size, start, last = np.diff(offsets), data[offsets[:-1]], offsets[1:]
        spaced, marked = (size > 1) & (start == 32), (size > 1) & self.marks[start]
        spaced[spaced] = (_solid_from(data, offsets[:-1][spaced] + 1)
                          & _solid_before(data, last[spaced]))
        marked[marked] = _letter_before(data, last[marked])
        order = np.argsort(np.where(spaced, 0, np.where(marked, 1, 2)), kind="stable")
        pieces, n = pieces.take(pa.array(order)), int((spaced | marked).sum())
        data, offsets = store.text_bytes(pieces.slice(0, n))
        group = offsets[1:] // JOINED_BYTES + (np.arange(n) >= spaced.sum())
        edges = offsets[[0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]]
        ids, _ = self._library([data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])])
        ends = np.searchsorted(np.cumsum(self.widths[ids]), offsets[1:]) + 1
        counts = np.diff(ends, prepend=0) if n else np.zeros(0, np.int64)
        more, more_counts = self._library([p.decode() for p in pieces.slice(n).to_pylist()])
        ids, counts = np.concatenate((ids, more)), np.concatenate((counts, more_counts))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids))
        self.seen = np.concatenate((self.seen, np.zeros(len(counts), np.int64)))
        place = np.empty(len(order), np.int64)
        place[order] = len(self.known) + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, pieces])
        return place

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids start."""
        data, offsets = store.text_bytes(array)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(array) + 1, np.int64)
        spaces = np.flatnonzero(data[1:-1] == 32) + 1
        spaces = spaces[_solid_before(data, spaces) & _solid_from(data, spaces + 1)]
        cut = np.zeros(len(data) + 1, bool)
        cut[spaces] = True
        marks = np.flatnonzero(self.marks.take(data[1:])) + 1
        cut[marks[_letter_before(data, marks)]] = True
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
            None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        if (len(self.known) + len(distinct) > KNOWN_PIECES
                or self.known.nbytes + distinct.nbytes > KNOWN_BYTES):
            self._forget()
        at = pc.index_in(distinct, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        if new.any():
            at[new] = self._learn(distinct.filter(pa.array(new)))
        self.seen[at] += 1
        at = at[coded.indices.to_numpy()]
        counts = self.counts[at]
        ids = self.ids[store.ranges(self.starts[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids, ends[np.searchsorted(cuts, offsets)]

    def spans(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Characters each token touches; tokens that share a split character both have it."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.widths[ids])
        return [(int(char[e - w]), int(char[e - 1]) + 1)
                for e, w in zip(ends, self.widths[ids])]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; a character split over tokens is whole again in the bytes."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple, Encoder] = {}
_TABLES: dict[str, list[bytes]] = {}


def decoding_table(path: str) -> list[bytes]:
    """Bytes of each id of a tokenizer file, without the tokenizer itself."""
    if path not in _TABLES:
        if path.endswith(".tiktoken"):
            ranks = read_ranks(path)
            table = [b""] * (max(ranks.values(), default=-1) + 1)
            for token, rank in ranks.items():
                table[rank] = token
        else:
            with open(path, encoding="utf-8") as file:
                held = json.load(file)
            table = byte_table(held["model"]["vocab"]
                               | {t["content"]: t["id"] for t in held.get("added_tokens", ())})
        _TABLES[path] = table
    return _TABLES[path]


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """One encoder per tokenizer file and Python process, with the pieces it knows."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(
            tokenizer_from_ranks(path, pattern) if path.endswith(".tiktoken")
            else tokenizer_from_file(path))
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text",
           keep: tuple[str, ...] = ("doc_id",), check: bool = False, decoded: bool = False) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to ``keep``.

    With ``check``, also ``round_trip``: whether decoding the ids gives the text's bytes.
    With ``decoded``, also the bytes that the ids decode to, by the byte table.

    Null and empty texts have no ids. Rows stay as they are, repeated ones included;
    columns outside ``keep`` are dropped, so their names cannot clash. A very long text is
    handled alone. ``path`` is a tokenizer's JSON file, or a rank file with its pattern.
    """
    rows = docs.select(*keep, docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern)
        for batch in store.slices(batches, "_text", SLICE_BYTES):
            array = store.texts(batch, "_text")
            ids, starts = use.encode(array)
            back = [use.decode(ids[a:b]) for a, b in zip(starts, starts[1:])] if check or decoded else []
            extra = [pa.array([x == t.as_buffer().to_pybytes() for x, t in zip(back, array)])] * check
            extra += [pa.array(back, pa.binary())] * decoded
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [
                None, pa.py_buffer(starts * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [*(store.column(batch, k) for k in keep), out.cast(pa.binary()),
                 pa.array(np.diff(starts)), *extra],
                names=[*keep, "ids", "n_tokens", *["round_trip"] * check, *["decoded"] * decoded])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(
        lambda batches: store.released(run(batches)), f"{schema}, ids binary, n_tokens bigint" + ", round_trip boolean" * check + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str, ids: str = "ids",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``decoded`` (binary UTF-8) for the ids of each row; null ids give empty bytes."""
    rows = tokens.select(*keep, tokens[ids].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(path)
        for batch in store.slices(batches, "_ids", SLICE_BYTES):
            out = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                   for x in store.column(batch, "_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(store.column(batch, k) for k in keep), pa.array(out, pa.binary())],
                names=[*keep, "decoded"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{schema}, decoded binary")
