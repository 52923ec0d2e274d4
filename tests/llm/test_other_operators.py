import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparktab.llm import embeddings, graph, warc


def components_brute(links):
    low = {x: x for e in links for x in e}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, monkeypatch, few):
    """In one task where few links are left, and by rounds of stars."""
    monkeypatch.setattr(graph, "CONTRACTED", few)
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_brute([e for e in links if e[0] != e[1]])
    assert all(found.get(x, x) == c for x, c in want.items()) and all(want[x] == c for x, c in found.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def vectors(rng):
    base = rng.normal(size=(40, 24))
    rows = []
    for i, v in enumerate(base):
        label = i % 3
        rows.append((v.tolist(), label))
        for noise in (0.05, 0.1, 0.18, 0.3):
            rows.append(((v + noise * rng.normal(size=24)).tolist(), label))
        if i % 5 == 0:
            rows += [(v.tolist(), label), (v.tolist(), (label + 1) % 3), ((v * 1e-3).tolist(), label), ((v * 1e30).tolist(), label)]
    hot = base[0]
    rows += [((hot + 0.04 * rng.normal(size=24)).tolist(), 0) for _ in range(60)]
    rows += [(None, 0), ([], 0), ([0.0] * 24, 0), ([1.0, None] + [0.0] * 22, 0), ([math.nan] * 24, 0), ([math.inf] + [1.0] * 23, 0), (base[1].tolist(), None), (base[1].tolist()[:20], 1), ([1.0], 0), ([2.0], 0)]
    return rows


def brute(rows):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ids = [i for i, (_, v, label) in enumerate(rows) if good(v, label) and rows[i][0] is not None]
    links = []
    for i in ids:
        for j in ids:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    low = components_brute([(rows[i][0], rows[j][0]) for i, j in links])
    return sorted(repr([r[0], n[i], low.get(r[0], r[0]), low.get(r[0], r[0]) == r[0]]) for i, r in enumerate(rows))


def test_embedding_dedup(spark):
    rows = [(i, v, label) for i, (v, label) in enumerate(vectors(np.random.default_rng(4)))]
    rows += [(None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("bucket", F.lit(1)).withColumn("h1", F.lit("x"))
    for block in (2048, 16):
        found = embeddings.near_duplicates(df, block=block)
        assert sorted(repr([r.vec_id, r.n_links, r.component_id, r.kept]) for r in found.collect()) == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()


def test_long_vectors(spark):
    """Vectors of thousands of components, and of lengths that are no power of two."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=3000), rng.normal(size=3000)
    rows = [(1, a.tolist(), 0), (2, (a + 0.05 * rng.normal(size=3000)).tolist(), 0), (3, b.tolist(), 0), (4, b.tolist()[:2999], 0), (5, (2 * b).tolist(), 0)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = embeddings.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(embeddings.hadamard(y), x)


def test_recall_of_buckets():
    """Pairs at the least cosine share a bucket (measured; the contract asks for 0.9)."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1)[:, None]
    a, b = embeddings.buckets(x), embeddings.buckets(y)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.999


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def test_revisits(spark):
    def record(i, kind, url, second, etag=None, modified=None, headers=None, payload=None):
        return (i, kind, url, None if second is None else at(second), 200, etag, modified, None, headers or {}, payload)

    a = "http://www.Example.com:80/x/?b=2&a=1&utm_source=q#top"
    rows = [
        record(1, "response", a, 1, '"one"', None, {"Content-Type": "text/html", "ETag": '"one"', "Content-Length": "5"}, b"first"),
        record(2, "response", "https://example.com/x?a=1&b=2", 5, 'W/"two"', "Mon", {"Cache-Control": "no"}, b"second"),
        record(3, "response", "https://example.com/x?a=1&b=2", 5, '"three"', None, {}, b"third"),
        record(10, "revisit", "example.com/x?a=1&b=2", 3, 'W/"one"', None, {"cache-control": "max-age=1", "content-length": "0", "Transfer-Encoding": "x"}),
        record(11, "revisit", a, 5, '"one"'), record(12, "revisit", a, 6, '"three"'), record(13, "revisit", a, 7, '"two"'), record(14, "revisit", a, 8),
        record(15, "revisit", "http://other.com/", 9, '"x"'), record(16, "revisit", None, 9, '"x"'), record(17, "revisit", " ", 9, '"x"'), record(18, "revisit", a, None, '"one"'), record(19, "revisit", a, 1, '"one"'),
        record(12, "revisit", a, 6, '"three"'), record(30, "warcinfo", a, 2), record(4, "response", "http://other.com", None, '"x"', None, {}, b"untimed"),
    ]
    df = spark.createDataFrame(rows, warc.SCHEMA).withColumn("row", F.lit("clash")).withColumn("source", F.lit(1))
    found = [(r.record_id, r.state, r.source_id, bytes(r.payload) if r.payload is not None else None) for r in warc.resolve(df).orderBy("record_id").collect()]
    assert found == [
        (10, "resolved", 1, b"first"), (11, "resolved", 1, b"first"), (12, "resolved", 3, b"third"), (12, "resolved", 3, b"third"), (13, "mismatch", None, None), (14, "no-validator", None, None),
        (15, "no-response", None, None), (16, "no-url", None, None), (17, "no-url", None, None), (18, "no-response", None, None), (19, "no-response", None, None),
    ]
    headers = warc.resolve(df).filter("record_id = 10").first().headers
    assert headers == {"content-type": "text/html", "etag": '"one"', "content-length": "5", "cache-control": "max-age=1"}
    assert warc.resolve(df.limit(0)).isEmpty()


def test_as_of_join_of_one_hot_url(spark):
    """Against brute force, with many captures of one URL over several ranges."""
    import random

    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"u{i % 7}", rng.randint(0, 500), i, rng.random() < 0.3) for i in range(900)]
    df = spark.createDataFrame([(i, k, t, n, r) for i, k, t, n, r in rows], "row long, key string, ts long, record_id long, response boolean")
    found = {r.row: r.source for r in warc.latest_before(df).collect()}
    for i, k, t, _, response in rows:
        if not response:
            before = [(t2, i2) for i2, k2, t2, _, r2 in rows if r2 and k2 == k and t2 < t]
            assert found[i] == (max(before)[1] if before else None)


def test_warc_files(spark, tmp_path):
    records = [
        {"kind": "response", "url": "http://a.com/", "ts": "2024-01-01T00:00:01Z", "status": 200, "digest": "sha1:X", "headers": {"ETag": '"1"', "Content-Type": "text/html"}, "payload": b"body\r\n\r\nWARC/1.0 inside"},
        {"kind": "warcinfo", "url": None, "ts": "2024-01-01T00:00:02Z"},
        {"kind": "revisit", "url": "http://a.com", "ts": "2024-01-01T00:00:03Z", "status": 304, "headers": {"ETag": '"1"', "Date": "now"}, "payload": b""},
    ]
    for name, packed in (("a.warc.gz", True), ("b.warc", False)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(warc.to_warc(records, packed) + (b"" if packed else b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"))
        table = warc.read_warc(spark, str(folder))
        assert sorted(r.kind for r in table.collect()) == ["broken", "response", "revisit"][packed:]
        row = warc.resolve(table).first()
        assert (row.state, bytes(row.payload), row.headers["date"]) == ("resolved", records[0]["payload"], "now")


def test_headers_that_differ_in_case(spark):
    rows = [
        (1, "response", "http://a.com", at(1), 200, '"1"', None, None, {"ETag": '"1"', "etag": '"2"', "Link": "x", "LINK": None, "Vary": "a"}, b"x" * 3_000_000),
        (2, "revisit", "http://a.com", at(2), 304, '"1"', None, None, {"Vary": "b", "vary": "c", "Te": "no", "X": None}, None),
        (3, "revisit", "http://a.com", at(3), 304, '"1"', None, None, None, None),
    ]
    found = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.SCHEMA)).collect()}
    assert found[2].headers == {"etag": '"1", "2"', "link": "x", "vary": "b, c", "x": None} and len(found[2].payload) == 3_000_000
    assert found[3].headers == {"etag": '"1", "2"', "link": "x", "vary": "a"}


def test_broken_warc_files(spark, tmp_path):
    def one(i, size=100):
        return warc.to_warc([{"kind": "response", "url": f"http://a.com/{i}", "ts": "2024-01-01T00:00:01Z", "headers": {}, "payload": b"z" * size}], True)

    middle = bytearray(one(2, 5000))
    middle[20:30] = b"\xff" * 10
    files = {"a.gz": one(1) + bytes(middle) + one(3) + b"\0" * 50, "b.gz": one(4) + one(5)[:-20], "c": b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.com/6\r\nContent-Length: 0\r\n\r\n", "d": b"", "e": b"\x1f\x8b"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in found if r.kind == "response") == [f"http://a.com/{i}" for i in (1, 3, 4, 6)]
    assert sorted(r.headers["error"] for r in found if r.kind == "broken") == ["bad length", "broken compression", "cut short", "cut short"]
    assert warc.resolve(warc.read_warc(spark, str(tmp_path))).isEmpty()


def test_many_members_take_time_in_proportion():
    import time

    member = warc.to_warc([{"kind": "revisit", "url": "http://a.com", "ts": "2024-01-01T00:00:01Z", "payload": bytes(np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8))}])
    began = time.time()
    assert sum(1 for _ in warc.parse(member * 3000)) == 3000
    assert time.time() - began < 20
