import zlib

import numpy as np

from helixframe.llm import quality, queries


def _net(seed=0):
    rng = np.random.default_rng(seed)
    f = quality.FILTERS
    return quality.Network(rng.normal(size=(256, quality.EMBED)).astype(np.float32), rng.normal(size=(quality.WIDTH * quality.EMBED, f)).astype(np.float32), rng.normal(size=f).astype(np.float32), rng.normal(size=2 * f) * 0.05, 0.1)


def _brute(net, text):
    """One filter, place and chunk after another."""
    n = max(1, -(-len(text) // quality.CHUNK))
    raw = text + b"\0" * (n * quality.CHUNK + quality.REACH - len(text))
    chunks = []
    for c in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for p in range(c * quality.CHUNK, (c + 1) * quality.CHUNK, quality.STRIDE):
            x = np.concatenate([net.embed[b] for b in raw[p : p + quality.WIDTH]])
            best = np.maximum(best, x @ net.filters + net.shift)
        chunks.append(np.maximum(best, 0))
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(z @ net.weights + net.bias)))


def test_scores_cover_the_whole_text():
    net = _net()
    rng = np.random.default_rng(3)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 512, dtype=np.uint8)), bytes(rng.integers(0, 256, 1700, dtype=np.uint8)), b"a" * 513]
    assert np.allclose(net.scores(texts), [_brute(net, t) for t in texts], atol=1e-5)
    assert abs(net.scores([b"x" * 5000])[0] - net.scores([b"x" * 4990 + b"ZZZZZZZZZZ"])[0]) > 1e-6


def test_very_long_texts_go_in_parts():
    net, rng = _net(1), np.random.default_rng(4)
    text = bytes(rng.integers(0, 256, quality.CHUNK * 4500, dtype=np.uint8))
    high = net.highest(quality.chunks_of(text))
    z = np.concatenate([high.mean(axis=0, dtype=np.float64), high.max(axis=0)])
    assert np.allclose(net.scores([text, b"x"])[0], 1 / (1 + np.exp(-(z @ net.weights + net.bias))), atol=1e-6)


def test_fit_learns():
    rng = np.random.default_rng(0)
    make = lambda bad: bytes(rng.integers(97, 123, 900, dtype=np.uint8)) + (b" BAD!! BAD!!" * 9 if bad else b"") + bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    labels = np.array([i % 2 for i in range(240)], np.float64)
    texts = [make(not y) for y in labels]
    net = quality.fit([quality.chunks_of(t) for t in texts[:160]], labels[:160])
    right = (net.scores(texts[160:]) >= 0.5) == labels[160:]
    assert right.mean() > 0.95
    assert quality.fit([], np.zeros(0)).scores([b"", b"x"]).tolist() == [0.5, 0.5]
    assert np.allclose(quality.fit([quality.chunks_of(b"a")] * 8, np.ones(8)).scores([b"q"]), 0.9)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, None, "s"), (2, None, "s"), (None, "", None), (5, "long " * 60_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    out = quality.score(docs, net).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.train(docs, labels.limit(0)).scores([b"x"])[0] == 0.5
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns
    assert quality.score(docs.limit(0), net).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_quality"](spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.92
    good = [b for a, b in held if a == 1]
    assert np.mean(good) >= 0.97


def test_the_fit_sees_whole_texts(spark, monkeypatch):
    """What is given to the fit are all chunks of each sampled text; a bound on bytes leaves texts out, and cuts none."""
    rng = np.random.default_rng(6)
    texts = {i: "".join(map(chr, rng.integers(97, 123, 20_000))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda chunks, labels: seen.append(chunks))
    quality.train(docs, labels)
    whole = {quality.chunks_of(t.encode()).tobytes() for t in texts.values()}
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in texts) and {c.tobytes() for c in seen[0]} <= whole
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 50_000)
    quality.train(docs, labels)
    assert len(seen[1]) == 3 and {c.tobytes() for c in seen[1]} <= whole


def test_fit_finds_defects_in_any_chunk_and_in_parts(monkeypatch):
    """Long texts whose only defect is in one of 40 chunks; looked at in parts of any size with the same result."""
    rng = np.random.default_rng(1)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    labels = np.array([i % 2 for i in range(60)], np.float64)
    texts = []
    for y in labels:
        at = int(rng.integers(0, 20_000))
        texts.append(letters(at) + (b"" if y else b" BAD!! BAD!!" * 9) + letters(20_000 - at))
    chunks = [quality.chunks_of(t) for t in texts]
    one = quality.fit(chunks, labels, passes=1)
    monkeypatch.setattr(quality, "TOGETHER", 7)
    other = quality.fit(chunks, labels, passes=1)
    assert np.allclose(one.filters, other.filters, atol=1e-3) and np.allclose(one.scores(texts), other.scores(texts), atol=1e-3)
