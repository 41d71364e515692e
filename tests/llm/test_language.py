import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import language, queries
from helixframe.llm.text import mix


def _brute(word):
    """Hashes of the n-grams of one word, by slicing."""
    s = "".join(c if c.isalpha() else "\0" for c in f" {word} ")
    out = Counter()
    for n in range(1, language.LONGEST + 1):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if any(c == "\0" for c in g[1:-1]) or not any(c != "\0" for c in g):
                continue
            h = n
            for c in g:
                h = (h * 0x100000001B3 + (0 if c == "\0" else ord(c))) % 2**64
            out[int(mix(np.array([h], np.uint64))[0] % np.uint64(language.FEATURES))] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcéß,.-0日𝒳'"), min_size=1, max_size=9), min_size=1, max_size=5))
def test_features(words):
    ids, n = language.features(words)
    ends = np.cumsum(n)
    for w, a, b in zip(words, ends - n, ends, strict=True):
        assert Counter(ids[a:b].tolist()) == _brute(w)


def test_fit_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    examples, labels = [], []
    for i in range(400):
        y = i % 3
        rows = np.unique(np.concatenate([rng.integers(0, 500, 30), 1000 + y * 20 + rng.integers(0, 20, 6)]))
        examples.append((rows, np.full(len(rows), 0.5)))
        labels.append(y)
    m = language.fit(examples, labels, ["a", "b", "c"])
    w = np.zeros((language.FEATURES, 3))
    w[m.rows] = m.weights
    right = np.mean([np.argmax(x @ w[r] + m.bias) == y for (r, x), y in zip(examples, labels, strict=True)])
    assert right > 0.95 and 0 < len(m.rows) < 600 and 0.05 <= m.temperature <= 20


def test_small_tables(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)] + [(90, None, "en"), (91, None, None), (92, "123 ... !", "de"), (93, "the dog", None), (93, "the dog", None), (None, "die katze " * 30_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score")
    model = language.train(df)
    got = {(r.doc_id, r.text and r.text[:5]): r for r in language.predict(df, model).collect()}
    assert language.predict(df, model).count() == len(rows)
    assert got[0, "the c"].lang_pred == "en" and got[1, "der h"].lang_pred == "de" and got[93, "the d"].lang_pred == "en" and got[None, "die k"].lang_pred == "de"
    for key in ((90, None), (91, None), (92, "123 .")):
        assert got[key].lang_pred == "und" and got[key].score == 0
    none = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_frequencies_cover_all_documents(spark):
    df = spark.createDataFrame([(f"ab w{i}",) for i in range(50)] + [("zz",)], "text string").repartition(3)
    got, n = language.document_frequencies(df)
    assert n == 51 and got[next(iter(_brute("zz") - _brute("z")))] >= 1
    for feature in _brute("ab"):
        assert got[feature] >= 50


def test_query(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.QUERIES["op7_language"](spark, d).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) >= 0.98
