import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

P = pytest.importorskip("public_tokenizers")

from helixframe.llm import bpe, mixing  # noqa: E402
from tests.llm.test_ngrams import _components  # noqa: E402
from tests.llm.test_substrings import _removed  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.good(spark, docs, sf_dir).cache()
    assert good.columns == columns and 0 < good.count() <= len(text)
    assert all(r.text == text[r.doc_id] for r in good.collect())
    unlike = corpus_pipeline.unlike(spark, good, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in unlike.collect()) == sorted({c for _, _, c in _components(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)})
    unrepeated = corpus_pipeline.unrepeated(spark, unlike, sf_dir).cache()
    want = {d: [w for w, f in zip(ws, flags, strict=True) if not f] for d, ws, flags in _removed([(r.doc_id, r.text) for r in unlike.collect()])}
    assert {r.doc_id: (r.text or "").encode().split() for r in unrepeated.collect()} == want
    assert all(r.n_chars == len(r.text) for r in unrepeated.collect())
    weighted = corpus_pipeline.weighted(spark, unrepeated, sf_dir).cache()
    assert weighted.columns == columns
    sizes, taken = {}, {}
    for frame, into in ((unrepeated, sizes), (weighted, taken)):
        for r in frame.collect():
            into[r.source] = into.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    for s, t in zip(order, mixing.water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True):
        assert abs(taken.get(s, 0) - t) <= 2 * mixing.BLOCK + 0.02 * t
    own = {r.doc_id: r.text for r in unrepeated.collect()}
    assert all(set(r.text.encode().split()) <= set(own[r.doc_id].encode().split()) for r in weighted.collect())
    out = corpus_pipeline.encoded(spark, weighted, sf_dir).collect()
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert len(out) == weighted.count() and all(r.exact and codec.decode(r.ids).decode() == r.text and r.n_tokens == len(r.ids) for r in out)
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, ran.collect())) == sorted(map(str, out))
