import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallybrook.llm import bpe, dac, token_output

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# another usual way of splitting: marks may start a word, line ends follow marks
OTHER_PATTERN = (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}|"
                 r" ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")


@pytest.fixture(scope="module")
def plain():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab é 　\n\t'sd1%日😀\x85\x1c", max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for use in (bpe.encoder(JSON), bpe.encoder(RANKS, public_tokenizers.PATTERN)):
        ids, starts = use.encode(pa.array(texts))
        whole = [e.ids for e in use.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole


@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "a", " b", " ", "é", "\n", "|>", "<"]), max_size=12))
def test_special_strings_are_what_the_library_takes_them_for(parts):
    from tokenizers import Tokenizer
    fresh, text = Tokenizer.from_file(JSON), "".join(parts)
    ids, _ = bpe.encoder(JSON).encode(pa.array([text, "x"]))
    assert ids.tolist() == [i for t in (text, "x") for i in fresh.encode(t, add_special_tokens=False).ids]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet="aZé×÷Þß ,.:;!?\n'\u0301\u0100s1日_", max_size=40), min_size=1, max_size=4))
def test_words_end_at_marks(texts):
    for use in (bpe.encoder(JSON), bpe.encoder(RANKS, public_tokenizers.PATTERN), bpe.encoder(RANKS, OTHER_PATTERN)):
        ids, starts = use.encode(pa.array(texts))
        whole = [e.ids for e in use.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == whole


def test_a_word_is_asked_for_once_whatever_ends_it():
    use, asked = bpe.Encoder(bpe.tokenizer_from_file(JSON)), []
    library = use._library
    use._library = lambda texts: asked.extend(texts) or library(texts)
    use.encode(pa.array(["some unlikelyword, here"]))
    asked.clear()
    text = "here unlikelyword.\nThere unlikelyword\nhere unlikelyword, some unlikelyword"
    ids, _ = use.encode(pa.array([text]))
    assert "unlikelyword" not in "".join(asked)
    assert ids.tolist() == use.tokenizer.encode(text, add_special_tokens=False).ids


def test_marks_of_special_tokens_cut_nothing():
    tokenizer = bpe.tokenizer_from_file(JSON)
    tokenizer.add_special_tokens(["<a.b>"])
    text = "x <a.b> y.z, w"
    ids, _ = bpe.Encoder(tokenizer).encode(pa.array([text]))
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 400)
    use = bpe.Encoder(bpe.tokenizer_from_file(JSON))
    for start in range(0, 300, 20):
        text = " ".join(f"word{i}" for i in range(start, start + 20))
        ids, _ = use.encode(pa.array([text]))
        assert ids.tolist() == use.tokenizer.encode(text, add_special_tokens=False).ids
    assert use.known.nbytes < 2000


def test_ids_and_round_trip(docs, plain):
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"))
    at_once = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"), check=True, decoded=True)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.round_trip for r in at_once.collect())
    back = bpe.decode(tokens, RANKS, keep=("doc_id", "text", "ids", "n_tokens"))
    rows = back.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_both_ways_to_the_bytes_agree():
    for path, pattern in ((JSON, None), (RANKS, public_tokenizers.PATTERN)):
        assert bpe.decoding_table(path) == bpe.encoder(path, pattern).table


def test_split_characters_have_a_span_in_each_token():
    use, text = bpe.encoder(JSON), "a 😀é"
    ids, _ = use.encode(pa.array([text]))
    spans = use.spans(text, ids)
    assert {c for a, b in spans for c in range(a, b)} == set(range(len(text)))
    assert sum(a <= 2 < b for a, b in spans) > 1


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.sampled_from([0, 1, 255, 256, 50256, 65535, 65536, 2**24, 2**32 - 1]), max_size=1500), data=st.data())
def test_any_range_of_a_shard(ids, data):
    raw = dac.pack(np.array(ids, np.uint32), np.array([7]), np.array([0]))
    shard = dac.Shard.of(raw)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.range(a, b).tolist() == ids[a:b]
    if ids:
        assert shard[len(ids) - 1] == ids[-1]
    with pytest.raises(IndexError):
        shard.range(0, len(ids) + 1)


def test_other_bytes_are_no_shard():
    with pytest.raises(ValueError):
        dac.Shard.of(b"x" * 40)


def test_token_files(docs, folder):
    manifest = token_output.write(docs, folder, JSON, shard_ids=50)
    assert manifest.count() >= 1
    rows = sorted(token_output.read(manifest).collect(), key=lambda r: r.start)
    use, start = bpe.encoder(JSON), 0
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [w.doc_id for w in want]
    texts = {}
    for w in want:
        texts.setdefault(w.doc_id, []).append(w.text or "")
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids[-1] == 0
        assert ids[:-1] in [use.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        start += len(ids)


def test_empty_tables(docs, folder):
    none = docs.limit(0)
    assert token_output.read(token_output.write(none, folder, JSON)).count() == 0
    assert bpe.decode(bpe.encode(none, JSON), JSON).count() == 0


def test_query_digests(spark, sf, plain):
    from tallybrook.llm import queries
    import hashlib
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in sorted(queries.QUERIES["op1_token_ids"](spark, sf).collect(), key=lambda r: r.doc_id):
        ids = np.array(plain.encode_ordinary(text[r.doc_id]) + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in queries.QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = np.array(plain.encode_ordinary(text[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_frequent_pieces_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 4000)
    use, asked = bpe.Encoder(bpe.tokenizer_from_file(JSON)), []
    learn = use._learn
    monkeypatch.setattr(use, "_learn", lambda pieces: asked.extend(pieces.to_pylist()) or learn(pieces))
    common = [f"common{i}" for i in range(40)]
    for start in range(0, 2000, 50):
        text = " ".join(["x", *common, *(f"once{i}" for i in range(start, start + 50)), "y"])
        ids, _ = use.encode(pa.array([text]))
        assert ids.tolist() == use.tokenizer.encode(text, add_special_tokens=False).ids
    assert use.known.nbytes < 8000
    assert all(asked.count(f" {w}".encode()) <= 2 for w in common)


def test_neighbouring_documents_are_read_together(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    want = {i: bpe.tokenizer_from_file(JSON).encode("some words " * (i % 7), add_special_tokens=False).ids + [0] for i in range(7)}
    for limit in (1, 20, 1 << 18):
        monkeypatch.setattr(token_output, "READ_IDS", limit)
        rows = sorted(token_output.read(token_output.write(docs, folder, JSON)).collect(), key=lambda r: r.start)
        assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [want[i % 7] for i in range(60)]
        assert [r.doc_id for r in rows] == list(range(60))
