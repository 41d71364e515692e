import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from helixframe.llm import bpe  # noqa: E402

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(VOCABULARY, P.PATTERN)
    ranks = {t: i for i, t in enumerate(own.tokens) if t}
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = st.text(st.one_of(st.sampled_from("  \n\t'sdtlre aaaabcd.,!?0123é日本ßΣ \u0085　\x1c​́"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=6))
def test_ids_equal_the_librarys(both, texts):
    own, lib = both
    flat, counts = own.encode_batch(texts)
    want = [lib.encode_ordinary(t) for t in texts]
    assert flat.tolist() == [i for w in want for i in w]
    assert counts.tolist() == [len(w) for w in want]
    assert own.decode(flat) == "".join(texts).encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "x y  z   w \n q", " ", "", "  a", "a  ", "'s's 'll", "the" * 2000, "<|endoftext|>"])
def test_long_and_odd_texts(both, text):
    own, lib = both
    assert own.encode(text) == lib.encode_ordinary(text)


def test_long_random_match(both):
    own, lib = both
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshr") for _ in range(4000))
    assert own.encode(text) == lib.encode_ordinary(text)


def test_unknown_ids_fail(both):
    for bad in (-1, 10**6):
        with pytest.raises(ValueError):
            both[0].decode([bad])


def test_operator(spark, both):
    rows = [(1, "The quick  brown fox.\n", 1.5), (2, None, 2.5), (2, None, 2.5), (3, "", None), (None, "long " * 40000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids double")
    out = bpe.decode(bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN)
    got = out.collect()
    assert len(got) == 5
    for r in got:
        text = r.text or ""
        assert r.ids == both[1].encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_query(spark, sf_dir, both):
    from helixframe.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op1_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = both[1].encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("pattern", [r"[^\r\n\p{L}\p{N}]?\p{L}+|\d+|\s+|.", r"\w+|\W+", r"\p{L}*"])
def test_other_patterns(pattern, both):
    lib = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(both[0].tokens) if t}, special_tokens={})
    own = bpe.codec(VOCABULARY, pattern)
    for text in ("Some words, 1234 and\n more's", "naïve café — 日本", "", "  "):
        if pattern == r"\p{L}*":  # matches nothing in places, which tiktoken doesn't take
            assert own.decode(own.encode(text)).decode() == "".join(c for c in text if c.isalpha())
        else:
            assert own.encode(text) == lib.encode_ordinary(text)


def test_one_pass_gives_the_same(spark):
    df = spark.createDataFrame([(1, "a b é 日本 \n", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, decoded string")
    got = bpe.encode(df, VOCABULARY, P.PATTERN, decoded="decoded")
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.doc_id: bytes(r.decoded).decode() for r in got.collect()} == {1: "a b é 日本 \n", 2: "", 3: ""}
    ids = spark.createDataFrame([([1, 2],), (None,), ([],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode(ids.coalesce(1), VOCABULARY, P.PATTERN).collect()].count(None) == 1
