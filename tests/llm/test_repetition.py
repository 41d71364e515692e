from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import queries, repetition


def _brute(words):
    """For each position, the longest substring that starts there and elsewhere too."""
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), max_size=4))
def test_repeats(texts):
    codes = np.array([w for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts]).astype(np.int64)
    assert repetition.repeats(codes, doc).tolist() == [x for t in texts for x in _brute(t)]


def _windows(words, k):
    n = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({p for i in range(len(words) - k + 1) if n[tuple(words[i : i + k])] > 1 for p in range(i, i + k)})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n\t#é", max_size=80), min_size=1, max_size=5))
def test_measures(texts):
    got = repetition.measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert got["n_words"][i] == len(words)
        assert got["word_chars"][i] == sum(len(w.decode()) for w in words)
        assert got["n_symbols"][i] == t.count("#")
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][i] == _windows(words, 5)
        assert got["n_covered"][i] == _windows(words, repetition.LEAST_REPEAT)


def test_operator(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    phrase = " ".join(f"p{i}" for i in range(60))
    rows = [(1, clean, "x"), (2, None, "x"), (2, None, "x"), (3, "", "y"), (4, "a b " * 50_000, "y"), (5, clean + " " + phrase + " mid " + clean.replace("w", "v") + " " + phrase + clean.replace("w", "u") * 1, None), (None, "too few", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = {(r.doc_id, (r.text or "")[:5]): r for r in repetition.verdict(repetition.measures(df)).collect()}
    assert out[1, "w0 w1"].kept and out[1, "w0 w1"].n_words == 300
    assert out[2, ""].base_failed and out[3, ""].n_words == 0
    assert out[4, "a b a"].base_failed and out[4, "a b a"].longest_repeat == 99_998
    assert not out[5, "w0 w1"].base_failed and not out[5, "w0 w1"].kept
    kept = repetition.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert repetition.keep_good(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.QUERIES["op10_repetition"](spark, sf_dir).collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(c.sql(queries.ORACLE_SQL["op10_repetition"]).fetchall())


def test_clean_documents_stay(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    q = queries.QUERIES["op10_repetition"](spark, sf_dir).where("not base_failed").join(good, "doc_id")
    assert q.where("kept").count() >= 0.98 * q.count() > 0
