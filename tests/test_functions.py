"""Column functions on literals."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import ids, quality, seq, tails
from helixframe.operators import stats


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


@pytest.mark.parametrize("text,n,odd", [("ACGT", False, False), ("ACNT", True, False), ("acnt", False, False), ("ACXT", False, True), ("AC GT\r\n", False, False), ("", False, False)])
def test_alphabet(one, text, n, odd):
    assert one(seq.has_n(F.lit(text))) is n and one(seq.has_non_acgtn(F.lit(text))) is odd


def test_bases(one):
    assert one(seq.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(seq.canonical(F.lit("TTT"))) == "AAA" and one(seq.canonical(F.lit("ACG"))) == "ACG"
    assert one(seq.kmers(F.lit("ACGTNACGT"), 1, 4)) == ["ACGT", "ACGT"] and one(seq.kmers(F.lit("ACG"), 1, 4)) == []
    assert one(seq.depleted_key(F.lit("ACGT"), "C")) == "ATGT" and one(seq.depleted_key(F.lit("ACGT"), "G")) == "ACAT"


def test_strict_parsers(one):
    assert one(seq.strict_number(F.lit("12"), "int")) == 12 and one(seq.strict_number(F.lit("12x"), "int")) is None and one(seq.strict_number(F.lit(" 1"), "int")) is None
    assert one(seq.strict_number(F.lit("1e3"), "double")) == 1000.0
    assert tuple(one(seq.semver(F.lit("1.4")))) == (1, 4, 0) and tuple(one(seq.semver(F.lit("2.3.10")))) == (2, 3, 10) and one(seq.semver(F.lit("1"))) is None


def test_illumina_levels(one):
    want = {0: 0, 1: 1, 2: 6, 9: 6, 10: 15, 19: 15, 20: 22, 24: 22, 25: 27, 29: 27, 30: 33, 34: 33, 35: 37, 39: 37, 40: 40, 60: 40}
    assert one(quality.illumina8(F.lit("".join(chr(33 + q) for q in want)))) == "".join(chr(33 + q) for q in want.values())


def test_quality_options(one):
    assert one(quality.apply(F.lit("!+5I"), "binary 20 40 6")) == "''II" and one(quality.apply(F.lit("!+5I"), "lossless")) == "!+5I"
    for bad in ("qvz", "binary 20 40", "binary 20 10 6", "binary 95 96 1", "lossless 1", "binary x y z"):
        with pytest.raises(ValueError):
            quality.apply(F.lit("!"), bad)


@pytest.mark.parametrize("text,n,base", [("C" + "A" * 20, 0, ""), ("C" + "A" * 21, 21, "A"), ("C" + "t" * 30, 30, "T"), ("A" * 25 + "C", 0, ""), ("A" * 25, 25, "A"), ("", 0, "")])
def test_polyat(one, text, n, base):
    info = tails.polyat_info(F.lit(text))
    assert tuple(one(info)) == (n, base)
    assert one(tails.polyat_restore(tails.strip(F.lit(text.upper()), info["len"]), info)) == text.upper()


@pytest.mark.parametrize(
    "tail,adapter,overlap",
    [(tails.ADAPTERS[0], 0, 19), (tails.ADAPTERS[0][:12], 0, 12), (tails.ADAPTERS[0][:11], -1, 0), (tails.ADAPTERS[1], 1, 19), (tails.ADAPTERS[1][:13].lower(), 1, 13), ("", -1, 0), (tails.ADAPTERS[1] + tails.ADAPTERS[0][:12], 0, 12)],
)
def test_adapters(one, tail, adapter, overlap):
    text = "GGGGGGG" + tail
    info = tails.adapter_info(F.lit(text))
    assert tuple(one(info)) == (adapter, overlap)
    assert one(tails.adapter_restore(tails.strip(F.lit(text.upper()), info["overlap"]), info)) == text.upper()


def test_bad_overlaps_and_short_barcodes_fail(one):
    with pytest.raises(Exception, match="no such adapter"):
        one(tails.adapter_restore(F.lit("ACG"), F.struct(F.lit(0).alias("adapter"), F.lit(25).alias("overlap"))))
    with pytest.raises(Exception, match="shorter than its barcode"):
        one(tails.barcode(F.lit("ACG"), 4))
    assert one(F.concat(tails.barcode(F.lit("ACGT"), 4), tails.after_barcode(F.lit("ACGT"), 4))) == "ACGT"


def test_policies():
    assert tails.may_strip_tails("rna", "high (x)", False, False) and not tails.may_strip_tails("rna", "medium", False, False) and not tails.may_strip_tails("rna", "N/A", False, True)
    assert tails.may_strip_adapters("sc-atac", "N/A", False, False, "R1") and not tails.may_strip_adapters("atac", "N/A", False, False, "R3") and not tails.may_strip_adapters("dna", "N/A", False, False, "R1")


@pytest.mark.parametrize(
    "a,b,code",
    [("@x/1", "@x/2", 1), ("@x", "@x", 2), ("@x 1:N:0", "@x 2:N:0", 3), ("@x 1", "@x 2", 1), ("@x 1y", "@x 2y", 3), ("@x 1 1:N", "@x 1 2:N", 3), ("@x 1 1:N", "@x 2 1:N", 0), ("@x", "@y", 0), ("@x/1", "@xx/2", 0)],
)
def test_pairs(one, a, b, code):
    found = ids.pair_code(F.lit(a), F.lit(b))
    assert one(found) == code
    assert one(ids.mate_name(F.lit(a), found)) == (b if code else None)


def test_index_suffix(one):
    both = ids.index_suffix(F.lit("AC"), F.lit("GT"))
    assert one(ids.strip_index(F.lit("@x:0:AC+GT"), both)) == "@x:0:" and one(ids.strip_index(F.lit("@x:0:AC+GA"), both)) == "@x:0:AC+GA"
    assert one(ids.restore_index(F.lit("@x:0:"), both)) == "@x:0:AC+GT" and one(ids.restore_index(F.lit("@x:0"), both)) == "@x:0"


def test_name_tokens(one):
    assert one(ids.tokens(F.lit("@S.12 1:N"))) == ["@", "S", ".", "12", " ", "1", ":", "N"]
    assert one(ids.joined(ids.tokens(F.lit("@S.12 1:N")))) == "@S.12 1:N"
    assert [one(ids.numeric(F.lit(t))) for t in ("0", "12", "012", "1234567890", "x")] == [0, 12, None, None, None]
    assert one(ids.synthetic(F.lit(4), 2)) == "@5/2"


def test_codes_signs_and_evidence_are_those_of_the_columns(spark):
    rng = random.Random(5)
    odd = [None, "", "ACGT", "A" * 16, "C" * 17, "acgtN" * 9, "\u00e4" + "ACGTT" * 8, "ACG\U0001f600" + "GATTACA" * 6, "G" * 9 + "a" * 21, "T" * 21 + "\n", "A" * 21 + "\r\n", "A" * 20, "AC" * 10 + tails.ADAPTERS[1][:12].lower(), tails.ADAPTERS[0][:11]]
    texts = odd + ["".join(rng.choice("ACGTacgtN" if i % 5 == 0 else "ACGT") for _ in range(rng.randint(10, 90))) for i in range(80)]
    rows = spark.createDataFrame([("R1" if i % 3 else None, t, f"@r{i} CB:Z:A" if i % 4 else "@r UMI:") for i, t in enumerate(texts)], "lane string, seq string, id string")
    for step in (5, 10):
        want = rows.select("lane", F.explode(F.transform(seq.kmers(F.col("seq"), step), seq.canonical)).alias("kmer")).groupBy("lane", "kmer").agg(F.count("*").alias("n"))
        got = stats._sampled(rows, "lane", step).groupBy("lane", "code").agg(F.sum("n").alias("n"))
        assert sorted(map(repr, got.select("lane", seq.kmer_of(F.col("code")).alias("kmer"), "n").collect())) == sorted(map(repr, want.collect()))
        assert want.where(seq.kmer_of(seq.kmer_code(F.col("kmer"))) != F.col("kmer")).count() == 0
    s = F.col("seq")
    same = rows.where(F.coalesce(tails.has_polyat(s), F.lit(False)) == F.coalesce(F.length(tails.polyat(s)) > 0, F.lit(False))).where(F.coalesce(tails.has_adapter(s), F.lit(False)) == (tails.adapter_info(s)["overlap"] > 0))
    assert same.count() == len(texts)
    known = rows.where("lane IS NOT NULL")
    want = stats.lane_rates(known).join(stats.composition(known), "lane").join(stats.upper_median(known.select("lane", F.length("seq").alias("len")), "lane", "len"), "lane")
    assert stats.lane_evidence(rows).select(want.columns).collect() == want.collect()
