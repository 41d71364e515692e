import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import graph, ngrams, queries


def _set(text, k=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _groups(rows, k, percent):
    """The sets of rows (doc_id, text), and a number of each one's component, by comparing all pairs."""
    sets = [_set(t, k) for _, t in rows]
    of = list(range(len(rows)))
    find = lambda i: i if of[i] == i else find(of[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    of[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def _components(rows, k=4, percent=85):
    """(doc_id, set size, smallest doc_id reachable) for rows (doc_id, text)."""
    sets, group = _groups(rows, k, percent)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_bounds(percent):
    """The numbers of tokens that similar sets may not share, for all small sizes and overlaps."""
    for x in range(1, 60):
        for y in range(x, 60):
            for n in range(x + 1):
                if 100 * n >= percent * (x + y - n):
                    assert n >= ngrams.least_overlap(x + y, percent) and x - n <= ngrams.slack(x, percent) and y - n <= ngrams.slack(y, percent)
                    assert (100 + percent) * n >= percent * (x + y)
                    if ngrams.slack(100 * x // percent, percent) == 0:
                        assert x == y == n


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.integers(6, 120), st.sampled_from([80, 85]), st.floats(0, 1))
def test_similar_sets_meet(seed, size, percent, share):
    """Two random similar sets always have a signature in common, whatever is frequent."""
    rng = np.random.default_rng(seed)
    universe = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    often = rng.random(len(universe)) < share
    rank = np.where(often, rng.permutation(len(universe)), -1)
    x = np.sort(rng.choice(len(universe), size, replace=False))
    y = x
    for _ in range(20):
        drop, add = rng.integers(0, ngrams.slack(size, percent) + 1, 2)
        z = np.union1d(rng.permutation(x)[drop:], rng.permutation(np.setdiff1d(np.arange(len(universe)), x))[:add])
        n = len(np.intersect1d(x, z))
        if 100 * n >= percent * (len(x) + len(z) - n):
            y = z
            break
    sigs = [np.concatenate([s[0], s[2]]) for s in (ngrams.signatures(universe[s], rank[s], percent) for s in (x, y))]
    tiny = [ngrams.slack(100 * len(s) // percent, percent) == 0 for s in (x, y)]
    assert len(np.intersect1d(*sigs)) or (any(tiny) and len(x) == len(y))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 3000), st.integers(0, 3000))
def test_bitmaps_never_differ_more_than_sets(seed, n, m):
    rng = np.random.default_rng(seed)
    every = rng.integers(0, 2**63, n + m, dtype=np.uint64)
    x, y = every[:n], every[rng.integers(0, n) :]
    assert ngrams.differing(ngrams.parities(x), ngrams.parities(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("held", [60, graph.HELD])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    of = {x: x for e in edges for x in e}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), held).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    line = lambda n: rng.choices(words, k=n)

    def edit(ws, n):
        ws = list(ws)
        for _ in range(n):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        return ws

    rows, i = [], 0
    passage = line(40)
    for n, copies, most in ((150, 60, 9), (40, 20, 3), (600, 8, 30), (12, 10, 1), (7, 6, 1)):
        base = line(n)
        for c in range(copies):
            rows.append((i, " ".join(edit(base, rng.randint(0, most))).title() if c % 3 == 0 else " ".join(edit(base, rng.randint(0, most)))))
            i += 1
    base = line(120)
    for _ in range(30):  # a chain: each an edit of the one before
        rows.append((i, " ".join(base)))
        base, i = edit(base, 1), i + 1
    for _ in range(60):
        rows.append((i, " ".join(line(rng.randint(0, 30)) + passage + line(rng.randint(0, 9)))))
        i += 1
    rows += [(i + k, t) for k, t in enumerate([None, "", " \n", "one", "ONE", "one two three", "one two three", "one two", "a b c d", "A b C d", "long " * 30_000 + "end", "é É", "É é"])]
    rng.shuffle(rows)
    return [*rows, (3, "one two three"), (None, rows[0][1]), (None, "nowhere else at all here"), (rows[5][0], rows[5][1])]


@pytest.mark.parametrize("frequent", [32, 3])
def test_small_tables(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngrams, "FREQUENT", frequent)
    if frequent == 3:
        monkeypatch.setattr(ngrams, "LOCAL", 2)
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1L as h", "length(text) as n")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.join(df.repartition(3)).collect()), key=key) == sorted(_components(rows), key=key)


def test_one_of_each(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1L as h")
    out = ngrams.one_of_each(df, 5, 80)
    assert out.columns == df.columns
    got = out.collect()
    sets, group = _groups(rows, 5, 80)
    # one row of each component, though two components may share their smallest doc_id
    keep = [min(rows[i][0] for i in own if rows[i][0] is not None) for g in set(group) if (own := [i for i in range(len(rows)) if group[i] == g]) and sets[g] and any(rows[i][0] is not None for i in own)]
    assert sorted(r.doc_id for r in got if r.doc_id is not None and _set(r.text, 5)) == sorted(keep)
    assert sum(r.doc_id is None or not _set(r.text, 5) for r in got) == sum(d is None or not s for (d, _), s in zip(rows, sets, strict=True))
    assert ngrams.one_of_each(df.limit(0)).count() == 0 and ngrams.join(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op3_ngram_jaccard"](spark, sf_dir).collect()) == sorted(_components(rows))


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op3_ngram_jaccard"](spark, sf_dir).collect())
    assert got == sorted(c.sql(queries.ORACLE_SQL["op3_ngram_jaccard"]).fetchall())


@pytest.mark.parametrize("percent", [80, 85])
def test_small_sets_of_frequent_tokens_meet(percent):
    """As above, from one token on, where all tokens are frequent and the larger set holds the smaller."""
    rng = np.random.default_rng(8)
    for size in range(1, 13):
        for larger in range(size + 1, 100 * size // percent + 1):
            for _ in range(200):
                y = np.sort(rng.integers(0, 2**63, larger, dtype=np.uint64))
                rank = rng.permutation(larger)
                inside = np.sort(rng.permutation(larger)[:size])
                sigs = [np.concatenate([s[0], s[2]]) for s in (ngrams.signatures(y[inside], rank[inside], percent), ngrams.signatures(y, rank, percent))]
                assert len(np.intersect1d(*sigs))


@pytest.mark.parametrize("percent", [80, 85])
def test_every_size_has_second_members_enough(percent):
    """Both group counts that a set uses: the counts of all similar sizes, and few enough even if all tokens are frequent."""
    for n in range(1, 3000):
        used = {ngrams.groups_for(n, percent), ngrams.groups_for(100 * n // percent, percent)}
        assert used == {ngrams.groups_for(m, percent) for m in range(n, 100 * n // percent + 1)}
        if ngrams.slack(100 * n // percent, percent):
            assert n - min(n, max(used)) > ngrams.slack(n, percent)


def test_a_short_notice_keeps_its_variants_together(spark, monkeypatch):
    """Variants of one word more link only through the notice."""
    rng = random.Random(4)
    notices = [[f"n{k}w{i}" for i in range(8)] for k in range(12)]
    rows = []
    for k, notice in enumerate(notices):
        rows.append((1000 * k, " ".join(notice)))
        rows += [(1000 * k + 1 + i, " ".join([f"x{rng.random()}", *notice] if i % 2 else [*notice, f"x{rng.random()}"])) for i in range(40)]
    monkeypatch.setattr(ngrams, "LOCAL", 1)
    kept = ngrams.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(r.doc_id for r in kept) == [1000 * k for k in range(12)]


def test_components_that_share_a_number_both_stay(spark):
    """Two unlike texts with one doc_id, each the smallest of its component."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a)]
    kept = ngrams.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b)])
