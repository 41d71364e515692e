import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import queries, substrings
from helixframe.llm.text import hash_words


def _removed(rows, window=substrings.WINDOW):
    """rows: (doc_id, text); flags of removed words, by comparing all windows."""
    first = {}
    for d, t in rows:
        ws = (t or "").encode().split()
        for i in range(len(ws) - window + 1):
            if d is not None:
                k = tuple(ws[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        ws = (t or "").encode().split()
        flags = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[i : i + window])] < d:
                flags[i : i + window] = [True] * window
        out.append((d, ws, flags))
    return out


def _digest(ws, flags):
    return hashlib.sha256(b" ".join(w for w, f in zip(ws, flags, strict=True) if not f)).hexdigest()


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=3), WORDS)
def test_matching_statistics(passages, words):
    got = list(substrings.SuffixAutomaton(passages).matching(words))
    inside = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    assert got == [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(words))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=3))
def test_equal_windows_have_equal_anchors(texts):
    words = [str(w).encode() for t in texts for w in t]
    hashed = hash_words([" \n".join(map(str, t)).encode() for t in texts])
    at, anchor = substrings.window_anchors(hashed.hashes, hashed.doc)
    assert len(at) == sum(max(0, len(t) - substrings.WINDOW + 1) for t in texts)
    by = {}
    for i, a in zip(at.tolist(), anchor.tolist(), strict=True):
        assert by.setdefault(tuple(words[i : i + substrings.WINDOW]), a) == a


def test_small_tables(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    common, passage, base = line(13), line(60), line(300)
    rows = [(i, f"{line(rng.randint(0, 30))}  \n{common} {line(5)}") for i in range(60)]
    rows += [(100 + i, f"{line(20)} {passage} {line(20)}\n{passage}") for i in range(30)] + [(200 + i, base) for i in range(40)]
    rows += [(300, base + " " + line(3)), (301, None), (302, ""), (303, "a " * 3000), (304, "a " * 500), (305, passage[: len(passage) // 2]), (None, base), (-9, base), (200, base + " second row with this id " + passage)]
    rows += [(400, f"{common.rsplit(' ', 1)[0]} almost {passage}"), (401, " ".join(rng.choices(words, k=60_000))), (402, common)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "length(text) as n_chars", "1 as start")
    want = sorted((str(d), len(ws), sum(f), _digest(ws, f)) for d, ws, f in _removed(rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(df.repartition(5)).collect()) == want
    out = substrings.dedup(df)
    assert out.columns == df.columns
    kept = sorted((str(r.doc_id), hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect())
    assert kept == [(w[0], w[3]) for w in want] or kept == sorted((w[0], w[3]) for w in want)
    same = {r.doc_id: r for r in out.collect()}
    assert same[301].text is None and same[302].text == "" and same[-9].text == base
    assert substrings.removed(df.limit(0)).count() == 0


def test_few_filter_bits_lose_nothing(spark, monkeypatch):
    """A filter that can tell little apart only lets more windows on."""
    monkeypatch.setattr(substrings, "MOST_BLOCKS", 1)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdef", k=200))) for i in range(30)] + [(30 + i, "x y z " + " ".join(str(j) for j in range(100)) + f" {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((d, sum(f)) for d, _, f in _removed(rows))
    assert sorted((r.doc_id, r.n_removed) for r in substrings.removed(df).collect()) == want


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((d, len(ws), sum(f), _digest(ws, f)) for d, ws, f in _removed(rows))
    assert sorted(tuple(r) for r in queries.QUERIES["op4_substrings"](spark, sf_dir).collect()) == want


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op4_substrings"](spark, sf_dir).collect())
    assert got == sorted(c.sql(queries.ORACLE_SQL["op4_substrings"]).fetchall())
