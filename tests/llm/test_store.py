import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from helixframe.llm import queries, store  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def _ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\t'sdtlre aABÉéb.,!?0123日ßΣ́\u0085 　\x1c<|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_ids_equal_the_librarys(text):
    assert store.word_ids(PATH).batch([text.encode()], 2)[0].tolist() == _ids(text)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, 20_000).astype("<u4")
    ends, again = store.cuts([ids, ids])
    assert ends == again
    assert ends[-1] == len(ids) and all(b - a <= store.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = store.cuts([np.concatenate([ids[:7], ids])])[0]
    assert len({e + 7 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert store.cuts([ids[:0], ids[:1]]) == [[], [1]] and store.cuts([]) == []
    assert store.cuts([np.zeros(10_000, "<u4")])[0][-1] == 10_000


@pytest.mark.parametrize("ids", [[], [0, 65535], [65536, 3]])
def test_pack(ids):
    assert store.unpack(store.pack(np.array(ids, "<u4"))).tolist() == ids


def test_store(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=6000))
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 900))) for i in range(40)} | {i: passage + f" tail{i}" for i in range(40, 60)} | {60: None, 61: ""}
    rows = [*texts.items(), (60, None), (41, texts[41]), (41, "another text"), (-5, "first"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", __import__("pyspark").sql.functions.lit("clash"))
    path = f"file://{tmp_path}/s"
    store.write(df.repartition(5), path, PATH, end=2)
    got = sorted(store.read(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    key = lambda i: (i is not None, i or 0)
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in rows)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    assert sorted((key(r.doc_id), bytes(r.ids)) for r in got) == sorted((key(i), np.array(_ids(t), "<u4").tobytes()) for i, t in rows)
    packs = spark.read.parquet(f"{path}/packs").collect()
    chunks = [(bytes(r.digests[c.seq]), c.shared) for r in packs for c in r.own]
    # only rows that share doc_id and text (60, 41) may keep a chunk twice
    assert len(chunks) - len({d for d, _ in chunks}) <= sum(len(r.own) for r in packs if r.doc_id in (60, 41))
    assert len(chunks) == len({d for d, _ in chunks})  # nor do these, as rows have numbers of their own
    assert any(shared for _, shared in chunks) and any(o is not None for r in packs for o in r.owners)


def test_changed_stores_fail(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(30)], "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    store.write(df, path, PATH, end=2)
    packs = spark.read.parquet(f"{path}/packs")
    other = packs.where("doc_id = 8").selectExpr("data as other")
    bad = packs.crossJoin(other).selectExpr("doc_id", "part", "start_in_part", "n_tokens", "root", "digests", "owners", "own", "if(doc_id = 7, other, data) as data")
    bad.write.parquet(f"{tmp_path}/t/packs")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{tmp_path}/t/manifest")
    with pytest.raises(Exception, match="another digest|its recipe says"):
        store.read(spark, f"file://{tmp_path}/t").collect()
    packs.where("doc_id <> 7").write.parquet(f"{tmp_path}/u/packs")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{tmp_path}/u/manifest")
    with pytest.raises(store.StoreError, match="manifest"):
        store.read(spark, f"file://{tmp_path}/u")


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    store.write(df, f"file://{tmp_path}/e", PATH, end=2)
    assert store.read(spark, f"file://{tmp_path}/e").count() == 0


def test_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(queries.QUERIES["op6_token_store"](spark, sf_dir).collect())
    start = 0
    for d, g in zip(docs, got, strict=True):
        ids = _ids(d.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
