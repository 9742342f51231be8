import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tallybrook.llm import chat, decontam, ngram_join, queries, secret_scan, stages, store, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", " = ", ":", '"', "AKIA", "ABCDEFGH1234", "0123abcdef", "a1B2c3D4e5", " ", "é", "api_key", "secret=ab", "x"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(secret_scan.Scanner().base(text)) == sorted(plain_base(text))
    if secret_scan.Scanner().spans(text):
        assert re.search(secret_scan.MAY_HOLD, text)


def test_entropy_windows_equal_a_plain_count():
    rng = random.Random(3)
    for cls in secret_scan.CLASSES:
        for _ in range(30):
            text = "".join(rng.choice(cls.chars + "..") if rng.random() < 0.9 else "a" for _ in range(120))
            hit = []
            for i in range(len(text) - cls.width + 1):
                w = text[i:i + cls.width]
                h = -sum(c / cls.width * math.log2(c / cls.width) for c in Counter(w).values())
                if set(w) <= set(cls.chars) and h >= cls.bits - 1e-9 and all(set(w) & set(n) for n in cls.needs):
                    hit.append(i)
            got = {p for a, b in secret_scan.windows(text, cls) for p in range(a, b)}
            assert got == {p for i in hit for p in range(i, i + cls.width)}


def test_allow_list_and_finds():
    s = secret_scan.Scanner()
    assert s.random_looking("key 9f8Kq2LxZ7vB4nM1pR6tWc3Y end")
    assert not s.random_looking("key EXAMPLE9f8Kq2LxZ7vB4nM1pR6tWc3Y end")
    assert not s.random_looking("550e8400-e29b-41d4-a716-446655440000")
    assert not s.random_looking("thisisaverylongwordwithoutdigitsinside")


def test_scan_and_redact(spark, docs):
    assert {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}[3] == []
    extra = spark.createDataFrame([(20, 'x token = "11acdfb36bb72224148e6160f674b4be45601bff" y', "en", 0)],
                                  "doc_id bigint, text string, lang string, n_chars bigint")
    row = secret_scan.redact(extra).first()
    assert row.text == 'x [SECRET]" y' and row.n_chars == len(row.text)
    same = secret_scan.redact(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.scan(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "|turn|>", "|end|>", "s>", "/s>", "INST]", "/INST]", "\n", "a"]), max_size=14))
def test_escapes_are_reversible(parts):
    text = "".join(parts)
    java = chat.ESCAPE, chat.UNESCAPE
    shown = re.sub(java[0], r"\1\2\\\3", text)
    assert not re.search(r"[<\[]" + chat._REST, shown)
    assert re.sub(java[1], r"\1\2\3", shown) == text


def test_events_fold(spark):
    log = [(1, 1, "open", 1, "user", ""), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"),
           (1, 4, "open", 2, "assistant", None), (1, 5, "delta", 2, None, "bad"), (1, 6, "regenerate", 2, None, None),
           (1, 8, "delta", 2, None, "good"), (1, 8, "delta", 2, None, "good"), (1, 9, "edit", 1, None, "hi"),
           (1, 10, "open", 3, "user", "gone"), (1, 11, "delete", 3, None, None), (None, 1, "open", 1, "user", "x")]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, event string, message bigint, role string, text string")
    got = sorted((r.conv_id or 0, r.message, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(0, 1, "user", "x"), (1, 1, "user", "hi"), (1, 2, "assistant", "good")]
    assert chat.parse(chat.render(chat.fold(df.limit(0)))).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|end|>\n[INST] \\ </s>"), (1, 1, "assistant", "é<\\s> <s>"), (1, 1, "assistant", None),
            (2, None, None, "x" * 2000), (None, 3, "odd\nrole", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(chat.log_of(df)))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", rows[0][3]), ("assistant", ""), ("assistant", rows[1][3])]
    assert "".join(back[1].learned) == rows[1][3]
    assert [(t.role, t.text) for t in back[2].turns] == [("", "x" * 2000)]
    assert [(t.role, t.text) for t in back[None].turns] == [("odd\nrole", "y")]


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows, n, p, q):
    sets = [(i, grams(t, n)) for i, t in rows]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and (a == b or q * len(s & t) >= p * len(s | t)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(((a is not None, a or 0), len(s), a if not s or a is None else root(a)) for a, s in sets)


def test_components_of_edge_cases(docs, folder):
    got = ngram_join.components(docs, folder).collect()
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], 3, 90, 100)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.components(docs.limit(0), folder).count() == 0


def near_texts(seed, count):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.choice([3, 9, 20, 60, 200]))] for _ in range(12)]
    out = []
    for i in range(count):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(w) // 15 + 1)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        out.append((i, " ".join(w)))
    return out


def test_components_equal_brute_force(spark, folder, monkeypatch):
    rows = near_texts(5, 160)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, p in ((3, 90), (5, 80)):
        got = ngram_join.components(df, folder, n, (p, 100)).collect()
        assert sorted(((True, r.doc_id), r.n_shingles, r.component_id) for r in got) == plain_components(rows, n, p, 100)


def test_components_of_blocks_that_are_cut(spark, folder, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 300)
    rows = near_texts(6, 90)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id bigint, text string"), folder).collect()
    assert sorted(((True, r.doc_id), r.n_shingles, r.component_id) for r in got) == plain_components(rows, 3, 90, 100)


def test_components_of_large_signature_groups(spark, folder, monkeypatch):
    """A limit of four sets: most groups are compared in pairs of parts."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    rows = near_texts(7, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.components(df, folder, 3, (90, 100)).collect()
    assert sorted(((True, r.doc_id), r.n_shingles, r.component_id) for r in got) == plain_components(rows, 3, 90, 100)


def plain_matches(docs, items, least=0.8):
    def norm(t):
        return [x for x in (w.lower().strip(decontam.MARKS) for w in re.split(r"[\x20\x09-\x0D]+", t or "")) if x]

    def bag(w):
        n = min(5, len(w))
        return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))

    found = set()
    for d, t in docs:
        w = norm(t)
        for i, b in items:
            x = norm(b)
            if not x or not w:
                continue
            own = bag(x)
            for s in range(max(1, len(w) - len(x) + 1)):
                win = w[s:s + len(x)]
                if min(5, len(win)) != min(5, len(x)):
                    continue
                v = bag(win)
                if sum((own & v).values()) >= least * sum((own | v).values()) - 1e-9:
                    found.add((d, i))
                    break
    return found


def test_contamination_equals_brute_force(spark, docs):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(rng.choice([2, 4, 5, 12, 30, 60])))) for i in range(25)]
    texts = []
    for i in range(200):
        words = [rng.choice("xyz") + str(rng.randrange(99)) for _ in range(rng.randrange(0, 80))]
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "edit"
        part = part[rng.randrange(0, 3):]
        at = rng.randrange(len(words) + 1)
        texts.append((i, " ".join(words[:at] + [f"{w.upper()}," for w in part] + words[at:])))
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "?!"), (93, items[3][1])], "item_id bigint, text string")
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = plain_matches(texts, items + [(93, items[3][1])])
    got = decontam.search(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == {i for i, _ in texts} - {d for d, _ in want}
    assert decontam.search(docs, bench).count() == 0 and decontam.search(df, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_benchmarks_of_many_batches(spark, monkeypatch):
    """Every batch of items finds its own, the broadcast of each but the last is let go."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(7)]
    docs = spark.createDataFrame(
        [(i, f"before {items[i][1]} after", "kept") for i in range(7)] + [(50, None, None), (51, "clean words only", ""), (3, items[3][1], None)],
        "doc_id bigint, text string, note string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted([(i, i) for i in range(7)] + [(3, 3)])
    live, made = set(), spark.sparkContext.broadcast

    def broadcast(value):
        assert not live
        shared = made(value)
        live.add(shared)
        destroy = shared.destroy
        shared.destroy = lambda blocking=False: (destroy(blocking), live.discard(shared))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    for size in (2, 7, 100):
        monkeypatch.setattr(decontam, "ITEM_BATCH", size)
        live.clear()
        assert sorted((r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()) == want
        live.clear()
        left = decontam.clean(docs, bench)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [50, 51]


def test_toxicity_on_held_out_rows(spark):
    import duckdb
    sf = "/root/testdata/sf0.1"
    label = dict(duckdb.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = [(label[r.doc_id], r.predicted) for r in queries.QUERIES["op6_toxicity"](spark, sf).collect()
            if r.held_out and r.doc_id in label]
    caught = sum(p for y, p in rows if y) / sum(y for y, _ in rows)
    wrong = sum(p for y, p in rows if not y) / sum(1 - y for y, _ in rows)
    assert caught >= 0.85 and wrong <= 0.01


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (8, 0), (None, 1), (4, None), (6, 0)], "doc_id bigint, label int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.clean(docs, none, 0.7).count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = stages.drop_toxic(spark, docs, sf)
    labels = stages.training_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, s in score.items() if s < 0.7}
    comp = {a[1]: c for a, n, c in plain_components([(i, texts[i]) for i in ids], 5, 80, 100)}
    ids = {i for i in ids if comp[i] == i}
    assert {r.doc_id for r in stages.drop_near_copies(spark, kept, sf).collect()} == ids
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids -= {d for d, _ in plain_matches([(i, texts[i]) for i in ids], items)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "byte_bpe"]


def test_stages_on_edge_cases(docs, sf):
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    one = stages.drop_near_copies(spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in one.collect()) == \
        [(False, 0), (False, 0)] + [(True, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)]
    for name, stage in stages.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
        assert stage(spark, docs, sf).count() >= 10 - 2 * (name == "toxicity")
    assert stages.to_tokens(spark, docs, sf).count() == docs.count()


def test_large_unrelated_sets_are_no_candidates():
    """64 counts cannot tell them from linked ones; more counts still keep every linked pair."""
    draw = np.random.default_rng(8)
    sizes = [5000, 5000, 5100, 5600, 4100, 5000]
    sets = [np.unique(draw.integers(0, 2**64, n, np.uint64)) for n in sizes]
    near = np.unique(np.concatenate((sets[0][500:], draw.integers(0, 2**64, 500, np.uint64))))    # 0.81 of sets[0]
    sets.append(near)
    a, b = ngram_join._near(np.arange(7), np.array([len(s) for s in sets]), [ngram_join.slot_counts(s) for s in sets], 0.8)
    assert list(zip(a.tolist(), b.tolist())) == [(6, 0)]
    small = [np.unique(draw.integers(0, 2**64, n, np.uint64)) for n in (8, 500)]
    assert [len(ngram_join.slot_counts(s)) for s in small] == [64, 64]


def test_free_memory_goes_back_after_a_task():
    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run():
        held = [np.ones(8000) for _ in range(2500)]       # 160 MB in chunks below the size that malloc maps alone
        pins.append(np.ones(8000))                        # keeps the top of the heap in use
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    pins, before = [], resident()
    assert [b.column(0)[0].as_py() for b in store.released(run())] == [2500]
    assert resident() < before + 60
