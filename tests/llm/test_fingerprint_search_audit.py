"""Order MinHash, ranked search and the filter audit against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import filter_audit, fingerprint, ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_text(draw, letters="ab cdé漢", n=60):
    return "".join(draw.choice(letters) for _ in range(draw.randrange(n)))


# -- order MinHash ----------------------------------------------------------------

def plain_signature(text, k, tuple_size, size):
    """The same selection by sorting, one text at a time."""
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    m = 0x9E3779B97F4A7C15
    points = [ord(c) for c in text]
    if 0 < len(points) < k:
        points += [0x110000] * (k - len(points))
    grams, ids, seen = [], [], {}
    for i in range(len(points) - k + 1):
        h = 0
        for c in points[i:i + k]:
            h = (h * m + c) & mask
        gram = mix(h)
        seen[gram] = seen.get(gram, -1) + 1
        grams.append(gram)
        ids.append(mix((gram + seen[gram] * m) & mask))
    out = []
    for j in range(size):
        if not grams:
            out.append(0)
            continue
        factor = mix((j + 1) * m & mask) | 1
        least = sorted(range(len(ids)), key=lambda i: ((ids[i] * factor & mask) >> 32, i))[:tuple_size]
        h = j + 1
        for i in sorted(least):
            h = mix((h * m + grams[i]) & mask)
        out.append(mix(h) >> 48)
    return out


def test_signatures_equal_plain_selection():
    draw = random.Random(5)
    texts = ["", "a", "abc", "aaaaaaaaaaaaaaaa", "x" * 300, "é😀漢" * 9, *(random_text(draw) for _ in range(40))]
    for k, tuple_size in ((3, 2), (8, 2), (4, 3)):
        found = fingerprint.signatures(*fingerprint.code_points(pa.array(texts)), k, tuple_size, 8)
        assert found.tolist() == [plain_signature(t, k, tuple_size, 8) for t in texts]


def test_order_counts_and_edits_cost():
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    small_edit = " ".join(["zzz" if i % 100 == 50 else w for i, w in enumerate(words)])
    moved = " ".join(words[200:] + words[:200])
    other = " ".join("".join(draw.choice("klmnopqrst") for _ in range(6)) for _ in range(400))
    a, b, c, d = fingerprint.of_texts(pa.array([text, small_edit, moved, other]))
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, d) == 0
    # all k-mers are still there after the move, but half of the pairs changed their order
    assert fingerprint.likeness(a, b) > 0.7 > fingerprint.likeness(a, c) > 0.2


def test_bytes_that_are_no_text():
    odd = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 2, 5], np.int32)),
                                                 pa.py_buffer(b"\xff\xfeabc")])
    points, starts = fingerprint.code_points(odd)
    assert starts.tolist() == [0, 2, 5] and points[2:].tobytes().decode("utf-32-le") == "abc"


def edited_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        yield doc_id, text, text[:len(text) - third] + after[:third], after


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_texts_and_likeness(spark, docs, parts):
    got = sorted(map(tuple, fingerprint.compare_edited(docs, parts).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = []
    for doc_id, text, edited, after in edited_by_hand(rows):
        a, b, c = fingerprint.of_texts(pa.array([text, edited, after]))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.as_text(a),
                     fingerprint.as_text(b), float((a == b).mean()), float((a == c).mean())))
    assert got == sorted(want, key=repr)


def test_many_ids_over_parts(spark):
    draw = random.Random(7)
    rows = [(i * 3 - 500, random_text(draw, n=200)) for i in range(700)] + [(10, "ten"), (10, "ten"), (10, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.compare_edited(df, 13).collect()}
    want = {(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited_by_hand(rows)}
    assert got == want


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")
    row = fingerprint.compare_edited(one, 5).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
    assert fingerprint.compare_edited(one.where("false"), 5).count() == 0
    assert fingerprint.fingerprints(one).first().fingerprint == row.fingerprint


# -- ranked search ----------------------------------------------------------------

def plain_ranking(docs, items, k=10):
    counted = []
    for doc_id, text in docs:
        found = TERM.findall((text or "").translate(A_TO_Z))
        if found:
            counted.append((doc_id, len(found), {t: found.count(t) for t in set(found)}))
    big_n, big_l = len(counted), sum(n for _, n, _ in counted)
    df = {}
    for _, _, tf in counted:
        for t in tf:
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in set(items):
        asked = set(TERM.findall((text or "").translate(A_TO_Z)))
        scored = []
        for doc_id, n, tf in counted:
            m = 100 - 90 + (90 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=repr)


def test_terms_of_odd_texts():
    texts = ["", " \n", "Añb-C3 _x\x7fÉ漢", "ab", "ab", "x" * 40000, "\x00a\x00", "É é"]
    found, starts = ranked.terms(pa.array(texts))
    got = [[t.decode() for t in found.to_pylist()[a:b]] for a, b in zip(starts, starts[1:])]
    assert got == [TERM.findall(t.translate(A_TO_Z)) for t in texts]


@pytest.mark.parametrize("batch_terms,cells,pairs", [(10_000, 1 << 24, 1 << 26), (8, 300, 1 << 26), (40, 1 << 24, 60)])
def test_ranking_equals_scoring_everything(spark, folder, monkeypatch, batch_terms, cells, pairs):
    """Small batches of items, small segments, ties, repeats, nulls and a frequent term."""
    monkeypatch.setattr(ranked, "SEGMENT_CELLS", cells)
    monkeypatch.setattr(ranked, "SEGMENT_PAIRS", pairs)
    draw = random.Random(8)
    words = [f"w{min(int(draw.expovariate(0.08)), 60)}" for _ in range(9000)]
    docs = [(i, " the ".join(words[i * 13:i * 13 + draw.randrange(30)])) for i in range(400)]
    docs += [(1000 + i, "copy of w3 and W4") for i in range(50)]
    docs += [(1000, "copy of w3 and W4"), (None, "copy of w3 and W4"), (None, None), (2000, None), (2001, ""),
             (2002, "only"), (2003, "w1 " * 20000)]
    items = [(i, " ".join(draw.sample(words, 6))) for i in range(25)]
    items += [(100, "w3 copy W4"), (100, "w3 copy W4"), (100, "only"), (101, None), (102, "absent"), (None, "the w2")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(5)
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    found = ranked.search(a, b, folder, 10, batch_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranking(docs, items)


def test_search_without_documents_or_items(spark, folder):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert ranked.search(docs.where("false"), items, folder).count() == 0
    assert ranked.search(docs, items.where("false"), folder).count() == 0


def test_blocks_are_skipped_by_their_bounds():
    """Each block's bound is at least every score in it, and low blocks stay closed."""
    draw = np.random.default_rng(3)
    n, size = 3000, 120     # six topics of 17 terms each, 18 terms that all topics share
    rows = [np.unique(np.concatenate((draw.integers(0, 17, 8) + 17 * (i % 6), draw.integers(102, size, 6))))
            for i in range(n)]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    codes = np.concatenate(rows)
    value = draw.integers(1, 1000, len(codes))
    weights = np.where(np.arange(size) < 102, 400, 100)
    queries = [np.concatenate((draw.choice(17, 3, replace=False) + 17 * (q % 6),
                               draw.choice(18, 3, replace=False) + 102)) for q in range(20)]
    asked = ranked.terms_beside(queries, size)
    made = ranked.segment(np.arange(n), starts, codes, value, asked, weights, per_block=8)
    cells = np.zeros((n, size), np.int64)
    cells[np.repeat(np.arange(n), np.diff(starts)), codes] = value
    searcher = ranked.Searcher(made, size)
    for query in queries:
        scores = cells[:, query] @ weights[query]
        for t in query:
            for b in range(made["lists"][t], made["lists"][t + 1]):
                docs = made["block_docs"][made["block_starts"][b]:made["block_starts"][b + 1]]
                a, z = made["summary_starts"][b:b + 2]
                most = dict(zip(made["summary_terms"][a:z], made["summary_values"][a:z]))
                assert sum(weights[q] * most.get(q, 0) for q in query) >= scores[docs].max()
        want = sorted((-int(s), i) for i, s in enumerate(scores) if s)[:10]
        assert searcher.best(query, weights[query], 10, []) == want
    assert searcher.opened < 0.5 * searcher.blocks


# -- filter audit -----------------------------------------------------------------

def plain_audit(docs, labels):
    failing, parts = [], {(d[2] or "") for d in docs}
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
                 + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
                 + "D" * bool(re.search(r"[#$%&*|]", text)))
        if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in docs):
            fails += "E"
        mine = [x for x in labels if x[0] is not None and x[0] == doc_id]
        failing.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    rows = []
    for part in parts:
        inside = [f for f in failing if f[0] == part]
        total, first = {}, []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = inside
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                fails = [f for f in inside if x in f[1]]
                total[x] = total.get(x, 0) + len(gone)
                first.append((part, order, step, len(left), len(gone), len(fails) - len(gone),
                              sum(f[1] == x for f in inside), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        rows += [(*r, total[r[1][r[2] - 1]]) for r in first]
    return sorted(rows)


def test_audit_equals_applying_the_filters(spark, folder):
    draw = random.Random(9)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "A#", "aa aa aa", long, long + " $", "X " * 400, "word " * 30000, "é😀\x00 *"]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice([None, "", "s1", "s2"])) for _ in range(150)]
    docs += [(100 + i, "copies everywhere", "hot") for i in range(60)] + [(7, long, "s1")] * 3
    labels = [(i, i % 2, i % 3 == 0) for i in range(120)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (900, 1, 1)]
    a = spark.createDataFrame(docs, "doc_id bigint, text string, part string").withColumn("bits", F.lit(5))
    b = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(a.withColumn("hash", F.lit("x")), b, folder)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)


def test_audit_of_nothing(spark, folder):
    docs = spark.createDataFrame([], "doc_id bigint, text string, part string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels, folder).count() == 0
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)), None)], docs.schema)
    rows = filter_audit.audit(one, labels, folder).collect()
    assert len(rows) == 600 and {(r.part, r.kept, r.removed, r.shapley) for r in rows} == {("", 1, 0, 0)}


def test_changed_texts_share_the_draws_of_their_unchanged_part(monkeypatch):
    draw = random.Random(11)
    texts = ["", "a", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "", *(random_text(draw, n=300) for _ in range(60)), "abc", "x" * 50]
    points, starts = fingerprint.code_points(pa.array(texts))
    length = np.diff(starts)
    kept = length[:-1] - length[:-1] // 3
    changed = [a[:k] + b[:len(a) - k] for a, b, k in zip(texts, texts[1:], kept.tolist())]
    new_points, new_starts = fingerprint.code_points(pa.array(changed))
    want = fingerprint.signatures(points, starts), fingerprint.signatures(new_points, new_starts)
    drawn, least = [], fingerprint._least
    monkeypatch.setattr(fingerprint, "_least", lambda ids, *more: drawn.append(len(ids)) or least(ids, *more))
    got = fingerprint.signatures_beside(points, starts, new_points, new_starts, kept)
    assert all((a == b).all() for a, b in zip(got, want))
    assert sum(drawn) < 1.5 * fingerprint.SIZE * len(points)
    for few in ([""], ["a"], ["", ""], ["a long enough text", ""]):
        points, starts = fingerprint.code_points(pa.array(few))
        length = np.diff(starts)[:-1]
        part, at = fingerprint.code_points(pa.array([t[:n - n // 3] for t, n in zip(few, length.tolist())], pa.string()))
        got = fingerprint.signatures_beside(points, starts, part, at, length - length // 3)
        assert (got[0] == fingerprint.signatures(points, starts)).all()
        assert (got[1] == fingerprint.signatures(part, at)).all()
