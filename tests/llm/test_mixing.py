import numpy as np
import pytest

from helixframe.llm import mixing, queries


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.water_fill([10, 1000, 1000], [5, 2, 1]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [5, 2]) == [0, 0]
    assert sum(mixing.water_fill([1, 2, 3, 4000], [5, 2, 1, 5])) == pytest.approx(4006)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutations(n):
    turns = {tuple(mixing.permute(np.arange(n), n, key).tolist()) for key in range(4)}
    assert all(sorted(t) == list(range(n)) for t in turns)
    assert n < 17 or len(turns) == 4


def test_shards_meet_the_slots():
    known = mixing.Plan([0, 1, 2], ["a", "b", None], [1, 1, 1], [9, 9, 9], [1.0, 1.0, 1.0], [700, 0, 1301])
    rows = list(known.shards(100, 7))
    assert sum(r[3] for r in rows) == 2001 and {r[0] for r in rows} == set(range(21))
    for s in (0, 2):
        own = [r for r in rows if r[1] == s]
        assert [r[2] for r in own] == np.cumsum([0, *(r[3] for r in own)])[:-1].tolist()
    assert len({r[3] for r in rows if r[1] == 0}) > 3  # drawn, not dealt evenly


def test_small_tables(spark):
    rows = [(1, "a b c " * 200, "s"), (2, None, "s"), (2, None, "s"), (3, "", None), (4, "x " * 50_000, None), (None, "y " * 90, "t"), (5, "q " * 100, "t"), (5, "q " * 100, "t"), (5, "r " * 100, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.totals(df.selectExpr("*", "'x' as size", "1 as block")).collect()
    again = mixing.totals(df.repartition(3)).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    sizes = {"s": 600, "t": 390, "null": 50_000}
    assert {r.source_size for r in got} == set(sizes.values())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for size in sizes.values():
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK
    assert mixing.totals(df.limit(0)).count() == 0
    out = mixing.mixed(df.selectExpr("*", "'x' as size", "length(text) as n_chars"))
    assert out.columns == ["doc_id", "text", "source", "size", "n_chars"]
    words = sum(len(r.text.split()) for r in out.collect())
    assert abs(words - 50_990) < 200


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op8_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes = {}
    for r in got:
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split())
        sizes[docs[r.doc_id].source] = sizes.get(docs[r.doc_id].source, 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = {}
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= 0.05 * targets[s] + 2 * mixing.BLOCK


def test_draws_beyond_a_thousand_million():
    left = np.array([6_000_000_000, 3, 0, 4_000_000_000], np.int64)
    rng = np.random.default_rng(3)
    drawn = mixing.draw(rng, left, 2_000_000_000)
    assert drawn.sum() == 2_000_000_000 and (drawn <= left).all() and abs(drawn[0] / 2e9 - 0.6) < 0.001
    assert mixing.draw(rng, left, int(left.sum())).tolist() == left.tolist()
    known = mixing.Plan([0, 1], ["a", "b"], [1, 1], [10**9, 10**9], [1.0, 1.0], [2 * 10**9, 10**9 + 7])
    rows = list(known.shards(mixing.SHARD, 5))
    assert sum(r[3] for r in rows if r[1] == 0) == 2 * 10**9 and sum(r[3] for r in rows if r[1] == 1) == 10**9 + 7
    assert len({r[0] for r in rows}) == -(-(3 * 10**9 + 7) // mixing.SHARD)


def test_blocks_follow_the_source():
    assert [mixing.block_for(s) for s in (0, 50_000, 2**20, 2**24, 2**40)] == [32, 32, 256, 4096, 4096]


@pytest.mark.parametrize("text", [None, "", "  \n", "a", " a ", "a b", "\ta\x0bb\x0cc\r\nd  ", "a\x1cb\u00a0c\u2028d e", "x" * 5000 + " y" * 70_000])
def test_word_counts(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert mixing.with_sizes(df).first()["size"] == len((text or "").encode().split())


def _taken(rows, block, per_shard):
    """The mix of unique (doc_id, source, text) in plain Python, with the operator's places, draws and permutations."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    known_sizes = [sum(len(t.split()) for _, s, t in rows if s == x) for x in sources]
    return sources, known_sizes, mixing.water_fill(known_sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])


def test_words_taken_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "b", "c", None][i % 4 if i % 3 else 0], "w " * int(rng.integers(0, 400))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    own, sized, known = mixing.mix_documents(df, per_shard=16)
    sources, sizes, targets = _taken(rows, mixing.BLOCK, 16)
    assert known.source == sources and known.size == sizes and known.target == pytest.approx(targets)
    times = {}
    for r in mixing.slots(spark, known, 16).collect():
        times[r.number, r.block] = times.get((r.number, r.block), 0) + 1
    assert all(0 < n <= 3 for n in times.values())
    want = {}
    for number, source in enumerate(sources):  # each source's documents end to end, cut into blocks
        placed = sorted((r["first"], r.doc_id, r["size"]) for r in mixing.positions(sized, 16).collect() if r.source == source)
        assert [p[0] for p in placed if p[2]] == np.cumsum([0, *(p[2] for p in placed if p[2])])[:-1].tolist()
        for first, doc_id, size in placed:
            want[doc_id] = sum(times.get((number, w // mixing.BLOCK), 0) for w in range(first, first + size))
    got = {r.doc_id: r.taken for r in mixing.totals(df).collect()}
    by = {}
    for r in own.collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.times * r.words
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in by.items() if n}
    assert set(got) == {r[0] for r in rows} and abs(sum(got.values()) - sum(sizes)) <= 4 * mixing.BLOCK


def test_mixed_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "s", "a b c " * 30, 7, "k")] * 2 + [(2, None, None, 8, "l")], "doc_id long, source string, text string, uid long, spans string")
    out = mixing.mixed(df)
    assert out.columns == df.columns and {(r.uid, r.spans) for r in out.collect()} == {(7, "k")}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_blocks_of_one_length_at_any_size(spark):
    """A source has the same blocks beside any number of further words."""
    sized = spark.createDataFrame([(1, "s", 1 << 20), (2, "t", 100)], "doc_id long, source string, size long")
    assert mixing.plan(sized).block == [mixing.BLOCK, mixing.BLOCK]
