import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import check
from tallybrook.llm import embed_dedup, graph, queries, url_filter, warc


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = db.execute(queries.sql()[name])
    assert check.canonical(df.columns, df.collect()) == check.canonical([d[0] for d in cur.description], cur.fetchall())


def test_graph(spark, folder):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 1), (5, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), folder, "g").collect()}
    assert got == {n: root(n) for a, b in links if a is not None and a != b for n in (a, b)}


def plain_vectors(rows, least=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {k: {j for j in ok if j != k and rows[j][2] == rows[k][2] and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= least} for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen), default=i) if i is not None else None
        out.append((i is not None, i or 0, len(links.get(k, ())), low, i == low))
    return sorted(out, key=str)


def test_vectors_equal_brute_force(spark, folder, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        centre = np.random.default_rng(i % 20).standard_normal(16)
        v = centre + rng.standard_normal(16) * (0.02 if i % 3 else 0.09)
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [float("nan")] + [1.0] * 15, 1),
             (405, [float("inf")] + [1.0] * 15, 1), (406, rows[1][1], None), (None, rows[1][1], 1), (407, rows[1][1], 1),
             (408, rows[1][1], 1), (409, [1e30] * 16, 1), (410, [3e-30] * 16, 1), (411, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = embed_dedup.near_duplicates(df, folder).collect()
    ours = sorted([(r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got], key=str)
    want = [(*w[:4], True) if not w[0] else w for w in plain_vectors(rows)]
    assert ours == sorted(want, key=str)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 4)
    small = embed_dedup.links.__defaults__
    monkeypatch.setattr(embed_dedup.links, "__defaults__", (4,))
    again = embed_dedup.near_duplicates(df, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and small == (512,)
    assert embed_dedup.near_duplicates(df.limit(0), folder).count() == 0


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.93 * a + math.sqrt(1 - 0.93 ** 2) * side
    args = embed_dedup.TABLES, embed_dedup.PROJECTIONS, embed_dedup.WIDTH, embed_dedup.SEED
    met = (embed_dedup.signatures(a, *args) == embed_dedup.signatures(b, *args)).any(1).mean()
    apart = (embed_dedup.signatures(a, *args) == embed_dedup.signatures(a[::-1].copy(), *args)).any(1).mean()
    assert met >= 0.98 and apart < 0.01


def archive(n=6, compress=True):
    rows, raw, at = [], b"", []
    for i in range(n):
        payload = (f"<p>{i}</p>" * 60).encode()
        row = {"record_id": i, "uri": f"http://x/{i}\n%", "payload": payload, "payload_bytes": len(payload), "refers_to": None,
               "payload_digest": hashlib.sha256(payload).hexdigest(), "record_type": "response"}
        one = warc.record_bytes(row)
        if compress:
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            one = pack.compress(one) + pack.flush()
        at.append(len(raw))
        raw, rows = raw + one, rows + [row]
    return rows, raw, [*at, len(raw)]


def salvaged(raw):
    return list(warc.salvage(pa.BufferReader(bytes(raw)), len(raw)))


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    rows, raw, at = archive(compress=compress)
    found = salvaged(raw)
    assert [f["payload"] for f in found] == [r["payload"] for r in rows] and found[1]["uri"] == rows[1]["uri"]
    broken = bytearray(raw)
    for p in range(at[2] + 30, at[2] + 60):
        broken[p] ^= 0xFF
    broken = b"junk" + bytes(broken) + raw[:at[1] - 9]
    found = salvaged(broken)
    assert [f["record_id"] for f in found if f["status"] == "record"] == [f"<urn:record:{i}>" for i in (0, 1, 3, 4, 5)]
    gaps = [(f["start"], f["end"]) for f in found if f["status"] == "gap"]
    assert gaps == [(0, 4), (at[2] + 4, at[3] + 4), (len(raw) + 4, len(broken))]
    spans = sorted((f["start"], f["end"]) for f in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(broken) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert salvaged(b"") == []


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_stands_any_flipped_byte(compress):
    """Whatever byte is damaged: no crash, all other records come back, every byte is told."""
    rows, raw, at = archive(3, compress)
    for p in range(len(raw)):
        for flip in (0xFF, 0x01):
            broken = bytearray(raw)
            broken[p] ^= flip
            found = salvaged(broken)
            spans = [(f["start"], f["end"]) for f in found]
            assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            hit = sum(a <= p for a in at[1:])
            assert {r["payload"] for i, r in enumerate(rows) if i != hit} <= {f.get("payload") for f in found}


@pytest.mark.parametrize("length", ["\u00b2", "9" * 5000, "-1", "+7", "1_0", "\u0661", "", "999999999999999999"])
def test_salvage_stands_odd_lengths(length):
    _, raw, at = archive(2, compress=False)
    one = raw[at[1]:]
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: " + length.encode() + b"\r\n\r\nabc\r\n\r\n"
    for first in (head, zlib.compress(head, wbits=31)):
        found = salvaged(first + one)
        assert [f["status"] for f in found] == ["gap", "record"] and found[0]["end"] == len(first)
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {length}\r\n\r\n".encode()
    again = (b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <x>\r\nContent-Length: " + str(len(http)).encode()
             + b"\r\n\r\n" + http + b"\r\n\r\n")
    found = salvaged(again + one)
    assert [f["status"] for f in found] == ["record", "record"]
    assert found[0]["payload_bytes"] == (int(length) if length.isascii() and length.isdigit() and len(length) < 19 else None)


def test_salvage_stops_at_members_that_swell(monkeypatch):
    """A member is unpacked to its header's length, or to the longest header, not to its end."""
    _, raw, at = archive(2)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\n"
    swelling = zlib.compress(head + b"0" * (64 << 20), wbits=31)
    endless = zlib.compress(b"WARC/1.1\r\n" + b"a" * (64 << 20), wbits=31)
    monkeypatch.setattr(warc, "HEAD_BYTES", 3 << 20)
    grown, real = [], warc.zlib.decompressobj

    class Counting:
        def __init__(self, wbits):
            self.inner = real(wbits)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def decompress(self, block, most):
            out = self.inner.decompress(block, most)
            grown.append(len(out))
            return out

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    found = salvaged(raw[:at[1]] + swelling + endless + raw[at[1]:])
    assert [f["status"] for f in found] == ["record", "gap", "record"]
    assert sum(grown) < 8 << 20


def test_salvage_of_long_records():
    """Records beyond all read blocks, packed well and badly, beside empty ones."""
    rng = random.Random(9)
    payloads = [b"", b"0" * (5 << 20), rng.randbytes(3 << 20), b"", b"1" * 100]
    for compress in (True, False):
        raw = b""
        for i, payload in enumerate(payloads):
            one = warc.record_bytes({"record_id": i, "uri": "u" * 70_000, "payload": payload, "payload_bytes": len(payload), "refers_to": None,
                                     "payload_digest": hashlib.sha256(payload).hexdigest(), "record_type": "response"})
            raw += zlib.compress(one, wbits=31) if compress else one
        assert [f.get("payload") for f in salvaged(raw)] == payloads


def test_warc_files(spark, folder):
    body = bytearray(b"x" * 120)
    rows = [(3, "u", body), (1, None, body), (1, "again", body), (2, "u", body), (4, "u", bytearray(b"x")), (5, "u", bytearray(b"x")),
            (6, "u", None), (None, "u", body)]
    df = spark.createDataFrame(rows, "record_id bigint, uri string, payload binary")
    got = warc.read(warc.write(warc.with_revisits(df), folder, file_bytes=300)).where("status = 'record'").collect()
    assert sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in got) == sorted(
        [("<urn:record:3>", "revisit", "<urn:record:1>", 120), ("<urn:record:1>", "response", "", 120), ("<urn:record:1>", "response", "", 120),
         ("<urn:record:2>", "revisit", "<urn:record:1>", 120), ("<urn:record:4>", "response", "", 1), ("<urn:record:5>", "response", "", 1),
         ("<urn:record:6>", "response", "", 0), ("<urn:record:>", "revisit", "<urn:record:1>", 120)])
    assert warc.read(warc.write(warc.with_revisits(df.limit(0)), folder)).count() == 0


def test_url_rules(spark, folder):
    urls = ["https://a.Example.org/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "http://b.org", "http://b.org/",
            "https://x.com/fr/1#f", "x.com/fr/1", None, "://y.com/de/", "http://notexample.org/es/", "http://z.net/a?q=/de/", "http://xcom/fr/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(1, urls[1], "clash")], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.RULES, folder).collect()}
    want = {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
            2: ("example.org", "/en/2", "org/", "allow"), 3: ("b.org", "", None), 4: ("b.org", "/", "org/", "allow"),
            5: ("x.com", "/fr/1", "com/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
            8: ("y.com", "/de/", "com/de/", "block"), 9: ("notexample.org", "/es/", "org/", "allow"), 10: ("z.net", "/a", None), 11: ("xcom", "/fr/", None)}
    for k, v in want.items():
        assert got[k][:len(v)] == v
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge(empty, queries.RULES, folder).count() == 0


def test_url_trees_learn_from_labels(spark, folder):
    rng = random.Random(2)
    rows = [(f"http://{rng.randrange(10**8)}.bad{i}.biz/{rng.randrange(10**9)}?a=1&b=2&c=3", 1) for i in range(150)]
    rows += [(f"https://www.site{i % 9}.com/news/{rng.choice(['sport', 'world', 'art'])}", 0) for i in range(150)]
    labelled = spark.createDataFrame(rows[::2], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, (), folder, labelled=labelled).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows)) >= 0.97 * len(rows)


def test_entropy_of_text(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "t string")
    assert [round(r[0], 9) for r in df.select(url_filter.entropy(F.col("t"))).collect()] == [1.0, 0.0, 2.0]
