import hashlib
import random

from pyspark.sql import functions as F

from helixframe.llm import queries, simhash


def _edited(rows):
    """rows: (doc_id, text), each doc_id once; the contract by lists."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = (t[: len(t) - k] + nxt[:k], order[(i + 1) % len(order)][0])
    return out


def test_edited_and_likeness(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "délta", "日本", "x", "😀"]
    rows = [(i * 7 - 50, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(10_000, None), (10_001, ""), (None, "no id at all here"), (20, "long " * 40_000)]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash"))
    got = {r.doc_id: r for r in simhash.compared(df.repartition(4)).collect()}
    want = _edited(rows)
    assert len(got) == len(rows)
    bits = {d: int(r.fingerprint, 16) for d, r in got.items()}
    for d, t in rows:
        r = got[d]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(want[d][0].encode()).hexdigest()
        assert r.near_edited == 1 - (bits[d] ^ int(r.edited_fingerprint, 16)).bit_count() / 64
        assert r.near_next == 1 - (bits[d] ^ bits[want[d][1]]).bit_count() / 64
        near = sum((bits[d] ^ b).bit_count() <= simhash.RADIUS for b in bits.values()) - 1
        assert r.n_near == (near if d is not None and d % 20 == 0 else None)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words"), (2, "a b c")], "doc_id long, text string")
    got = sorted(simhash.compared(df).collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert [(r.doc_id, r.n_chars) for r in got] == [(1, 5), (1, 5), (1, 11), (2, 5)]
    assert got[0] == got[1] and got[0].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert simhash.compared(df.limit(0)).count() == 0
    one = simhash.compared(df.where("doc_id = 2")).collect()[0]
    assert one.near_next == 1.0


def test_votes(spark):
    text = "one two one two three"
    words = text.split(" ")
    hashes = [spark.range(1).select(F.xxhash64(F.lit(w), F.lit(n).cast("string"))).first()[0] for w, n in zip(words, [*words[1:], None], strict=True)]
    want = sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))
    df = spark.createDataFrame([(1, text)], "k long, text string")
    assert simhash.fingerprints(df, ["k"], ["text"]).first().fp_text % 2**64 == want


def test_all_within_the_radius_are_found(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fp long")
    for radius, blocks in ((3, 6), (3, 4), (1, 3), (0, 2)):
        got = {(r.query, r.fp, r.distance) for r in simhash.near(df, df, radius, blocks).collect()}
        assert got == {(a, b, d) for a in set(signed) for b in set(signed) if (d := ((a ^ b) % 2**64).bit_count()) <= radius}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = _edited(docs)
    got = queries.QUERIES["op9_simhash"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    assert all(r.edited_sha256 == hashlib.sha256(want[r.doc_id][0].encode()).hexdigest() for r in got)
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1
