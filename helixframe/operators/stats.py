"""Statistics of reads, and the call of the assay that they come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import ids, seq, tails


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: num_reads, num_clean (without N), max_len, any_non_acgtn."""
    return reads.agg(F.count("*").alias("num_reads"), F.count(F.when(~seq.has_n(F.col("seq")), 1)).alias("num_clean"), F.max(F.length("seq")).cast("long").alias("max_len"), F.bool_or(seq.has_non_acgtn(F.col("seq"))).alias("any_non_acgtn"))


def is_long_mode(max_len: int, any_non_acgtn: bool) -> bool:
    return max_len > 511 or any_non_acgtn


def base_counts(by: list[str]) -> list[Column]:
    up = F.upper("seq")
    return [F.sum(F.length(up) - F.length(F.replace(up, F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"]


def composition(reads: DataFrame) -> DataFrame:
    """Bases A, C, G, T in either case, for each lane."""
    return reads.groupBy("lane").agg(*base_counts(["lane"]))


def upper_median(values: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place floor(n / 2) of each group in ascending order, from counts of equal values: no group is sorted as a whole."""
    counts = values.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    upto = F.sum("n").over(w.orderBy(value))
    found = counts.withColumns({"upto": upto, "total": F.sum("n").over(w)}).where(F.col("upto") > F.floor(F.col("total") / 2))
    return found.groupBy(by).agg(F.min(value).cast("long").alias("median"))


def _signs() -> dict[str, Column]:
    return {"polyat_rate": tails.has_polyat(F.col("seq")), "adapter_rate": tails.has_adapter(F.col("seq")), "barcode_rate": ids.has_barcode_tag(F.col("id")), "umi_rate": ids.has_umi_tag(F.col("id"))}


def lane_rates(reads: DataFrame) -> DataFrame:
    """For each lane, the shares of reads with a poly-A or poly-T tail, with an adapter, and with tags in the name."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return reads.groupBy("lane").agg(F.count("*").alias("num_reads"), *[share(c).alias(name) for name, c in _signs().items()])


def lane_evidence(reads: DataFrame) -> DataFrame:
    """``lane_rates``, ``composition`` and the upper median of lengths together, in one pass: all follow from sums over the reads of a length."""
    each = reads.where(F.col("lane").isNotNull()).groupBy("lane", F.length("seq").alias("len"))
    sums = each.agg(F.count("*").alias("num_reads"), *[F.count(F.when(c, 1)).alias(name) for name, c in _signs().items()], *base_counts(["lane"]))
    w = Window.partitionBy("lane")
    upto = sums.withColumns({"upto": F.sum("num_reads").over(w.orderBy("len")), "total": F.sum("num_reads").over(w)})
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len"))).cast("long").alias("median")
    rates = [(F.sum(name) / F.sum("num_reads")).alias(name) for name in _signs()]
    return upto.groupBy("lane").agg(F.sum("num_reads").alias("num_reads"), *rates, *[F.sum(f"n_{b}").alias(f"n_{b}") for b in "acgt"], median)


def _sampled(rows: DataFrame, group: str, step: int) -> DataFrame:
    """group, code, n: how often a canonical k-mer (see ``seq.batch_codes``) of every ``step``-th place occurs in the sequences ``seq`` of a group, counted in batches, so that a frequent k-mer is a row of
    each. Nothing is shuffled."""
    kind = rows.schema[group].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            place, code = seq.batch_codes(batch.column(1), step)
            # the group above the code's bits
            found, n = np.unique(names.indices.to_numpy().astype(np.int64)[place] << 2 * seq.K | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found >> 2 * seq.K)), pa.array(found & (1 << 2 * seq.K) - 1), pa.array(n.astype(np.int64))], names=[group, "code", "n"])

    return rows.select(group, "seq").mapInArrow(run, f"`{group}` {kind.simpleString()}, code long, n long")


def reference_codes(labelled: DataFrame) -> DataFrame:
    """As ``reference_kmers``, with the k-mers' codes instead of their letters."""
    special = F.when(F.col("label") != "BACKBONE", F.col("label"))
    merged = _sampled(labelled, "label", 5).groupBy("code").agg(F.min(special).alias("a"), F.max(special).alias("b"))
    return merged.select("code", F.when(F.col("a").isNull(), "BACKBONE").when(F.col("a") == F.col("b"), F.col("a")).otherwise("AMBIGUOUS").alias("label"))


def reference_kmers(labelled: DataFrame) -> DataFrame:
    """For sequences (label, seq): each canonical 17-mer of every fifth place with its label. Labels that disagree are AMBIGUOUS; BACKBONE
    gives way to any other."""
    return reference_codes(labelled).select(seq.kmer_of(F.col("code")).alias("kmer"), "label")


def kmer_hits(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """For each lane, the sampled 17-mers (every tenth place) and those labelled EXON, PROMOTER and INTRON_CTRL. ``reference``: of ``reference_kmers`` or ``reference_codes``. Its k-mers are
    unique, and a task keeps its share of those with these labels, so that the many of the reads are not sorted."""
    code = F.col("code") if "code" in reference.columns else seq.kmer_code(F.col("kmer"))
    known = reference.where(F.col("label").isin("EXON", "PROMOTER", "INTRON_CTRL")).select(code.alias("code"), "label")
    hit = lambda s: F.coalesce(F.sum(F.when(F.col("label") == s, F.col("n"))), F.lit(0)).alias(f"{s.lower().split('_')[0]}_hits")
    return _sampled(reads, "lane", 10).join(known.hint("shuffle_hash"), "code", "left").groupBy("lane").agg(F.sum("n").alias("sampled"), hit("EXON"), hit("PROMOTER"), hit("INTRON_CTRL"))


def depletion(hit: Column, other: Column) -> Column:
    return hit / (hit + other + 1)


def bisulfite_points(c: Column, t: Column, g: Column, a: Column) -> Column:
    """struct<points, base> of one mate from its base counts: 80 points for a C or G ratio of 0.10 at most, 40 for 0.15."""
    c_ratio, g_ratio = depletion(c, t), depletion(g, a)
    hits = lambda most: ((c + t > 100) & (c_ratio <= most), (g + a > 100) & (g_ratio <= most))
    base = lambda h: F.when(h[0] & h[1], F.when(c_ratio <= g_ratio, "C").otherwise("G")).when(h[0], "C").otherwise("G")
    strong, some = hits(0.10), hits(0.15)
    points = lambda n, b: F.struct(F.lit(float(n)).alias("points"), b.alias("base"))
    return F.when(strong[0] | strong[1], points(80, base(strong))).when(some[0] | some[1], points(40, base(some))).otherwise(points(0, F.lit("N")))


def atac_points(adapter_rate: Column, promoter_ratio: Column | None = None) -> Column:
    own = F.when(adapter_rate > 0.05, 90.0).when(adapter_rate > 0.01, 70.0).when(adapter_rate > 0.003, 35.0).otherwise(0.0)
    return own if promoter_ratio is None else own + F.when(promoter_ratio > 5, 50.0).when(promoter_ratio > 2, 25.0).otherwise(0.0)


def rna_points(polyat_rate: Column, bisulfite: Column, exon_ratio: Column | None = None) -> Column:
    own = F.when(bisulfite > 30, 0.0).when(polyat_rate > 0.05, 80.0).when(polyat_rate > 0.015, 60.0).otherwise(0.0)
    return own if exon_ratio is None else own + F.when(exon_ratio > 10, 60.0).when(exon_ratio > 5, 30.0).otherwise(0.0)


def pick(atac: Column, rna: Column, bisulfite: Column, least: float = 20.0) -> Column:
    """The assay with the most points of at least ``least``; of equal ones atac, then rna, then bisulfite; dna if there is none."""
    top = F.greatest(atac, rna, bisulfite)
    return F.when(top < least, "dna").when(atac == top, "atac").when(rna == top, "rna").otherwise("bisulfite")


def confidence(assay: Column, points: Column) -> Column:
    return F.when(assay == "dna", "low").when(points >= F.when(assay == "rna", 60.0).otherwise(70.0), "high").otherwise("medium")


def single_cell(barcode_rate: Column, umi_rate: Column, median_1: Column, median_2: Column, explicit: bool = False) -> Column:
    """Number of signs of a single-cell layout; promoted if there is one and the assay has such a form."""
    return sum((F.when(c, 1).otherwise(0) for c in (barcode_rate > 0.5, umi_rate > 0.5, (median_1 <= 45) & (median_2 - median_1 >= 30))), F.lit(int(explicit)))


def _evidence(reads: DataFrame, reference: DataFrame | None, explicit: bool) -> tuple[DataFrame, DataFrame]:
    """Evidence for each lane, and one row with the call over all of them."""
    lanes = lane_evidence(reads)
    of = lambda lane, c, none: F.coalesce(F.max(F.when(F.col("lane") == lane, F.col(c))), F.lit(none))
    tops = [F.max(c).alias(f"top_{c}") for c in ("polyat_rate", "adapter_rate", "barcode_rate", "umi_rate")]
    call = lanes.agg(*tops, *[of(lane, f"n_{b}", 0).alias(f"{lane.lower()}_{b}") for lane in ("R1", "R2") for b in "acgt"], *[F.max(F.when(F.col("lane") == lane, F.col("median"))).alias(f"median_{lane.lower()}") for lane in ("R1", "R2")])
    promoter = exon = None
    if reference is not None:
        hits = kmer_hits(reads, reference).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("exon_hits", "promoter_hits", "intron_hits")])
        call = call.crossJoin(F.broadcast(hits))  # one row each
        promoter, exon = F.col("promoter_hits") / (F.col("intron_hits") + 1), F.col("exon_hits") / (F.col("intron_hits") + 1)
    for m in ("r1", "r2"):
        call = call.withColumn(f"{m}_bisulfite", bisulfite_points(*[F.col(f"{m}_{b}") for b in "ctga"]))
    call = call.withColumn("bisulfite_points", F.col("r1_bisulfite.points") + F.col("r2_bisulfite.points")).withColumn("atac_points", atac_points(F.col("top_adapter_rate"), promoter)).withColumn("rna_points", rna_points(F.col("top_polyat_rate"), F.col("bisulfite_points"), exon))
    call = call.withColumn("base_assay", pick(F.col("atac_points"), F.col("rna_points"), F.col("bisulfite_points")))
    call = call.withColumn("signs", F.coalesce(single_cell(F.col("top_barcode_rate"), F.col("top_umi_rate"), F.col("median_r1"), F.col("median_r2"), explicit), F.lit(int(explicit))))
    call = call.withColumn("assay", F.when((F.col("signs") > 0) & (F.col("base_assay") != "dna"), F.concat(F.lit("sc-"), F.col("base_assay"))).otherwise(F.col("base_assay")))
    call = call.withColumn("confidence", confidence(F.col("base_assay"), F.greatest("atac_points", "rna_points", "bisulfite_points")))
    return lanes, call.withColumn("detail", _detail(promoter, exon, explicit))


#: Phrases of the evidence (fixed values).
_SAID = {"adapter": ("Tn5 adapters (>5%)", "Tn5 adapters", "Tn5 adapters (weak)"), "tail": ("poly-A/T tails (>5%)", "poly-A/T tails"), "promoter": "promoter alignment", "exon": "exon alignment",
         "none": "default", "layout": ("explicit lanes", "CB tags", "UMI tags", "read length asymmetry")}


def _detail(promoter: Column | None, exon: Column | None, explicit: bool) -> Column:
    """What speaks for the call, in words, behind its level."""
    c, said = F.col, _SAID
    mate = lambda m: F.when(c(f"{m}_bisulfite.points") == 80, F.concat(F.lit(f"{m.upper()} "), c(f"{m}_bisulfite.base"), F.lit("-depletion"))).when(c(f"{m}_bisulfite.points") == 40, F.concat(F.lit(f"{m.upper()} moderate "), c(f"{m}_bisulfite.base"), F.lit("-depletion")))
    rate = c("top_adapter_rate")
    adapter = F.when(rate > 0.05, said["adapter"][0]).when(rate > 0.01, said["adapter"][1]).when(rate > 0.003, said["adapter"][2])
    tail = F.when(c("bisulfite_points") > 30, F.lit(None)).when(c("top_polyat_rate") > 0.05, said["tail"][0]).when(c("top_polyat_rate") > 0.015, said["tail"][1])
    aligned = lambda ratio, least, s: F.lit(None) if ratio is None else F.when(ratio > least, said[s])
    own = F.when(c("base_assay") == "dna", said["none"]).when(c("base_assay") == "bisulfite", F.concat_ws(", ", mate("r1"), mate("r2")))
    own = own.when(c("base_assay") == "atac", F.concat_ws(", ", adapter, aligned(promoter, 5.0, "promoter"))).otherwise(F.concat_ws(", ", tail, aligned(exon, 10.0, "exon")))
    signs = (F.lit(explicit), c("top_barcode_rate") > 0.5, c("top_umi_rate") > 0.5, (c("median_r1") <= 45) & (c("median_r2") - c("median_r1") >= 30))
    layout = F.concat_ws(", ", *[F.when(x, s) for x, s in zip(signs, said["layout"], strict=True)])
    sc = F.when(F.startswith(c("assay"), F.lit("sc-")), F.concat(F.lit("; sc: "), layout)).otherwise("")
    return F.concat(c("confidence"), F.lit(" ("), own, sc, F.lit(")"))


def assay_call(reads: DataFrame, reference: DataFrame | None = None, explicit: bool = False) -> DataFrame:
    """Evidence for each lane, with the call over all of them: points, assay, confidence. Lanes are R1, R2 and others. ``reference``: labelled k-mers (see
    ``reference_kmers``), whose hits add to the points; ``explicit``: index lanes were given, which speaks for single cells."""
    lanes, call = _evidence(reads, reference, explicit)
    return lanes.crossJoin(F.broadcast(call.select("bisulfite_points", "atac_points", "rna_points", "assay", "confidence")))  # one row


def assay_detail(reads: DataFrame, reference: DataFrame | None = None, explicit: bool = False) -> DataFrame:
    """One row: assay, confidence with the evidence in words, and how bisulfite reads are to be coded: depleted_1, depleted_2 (C or G, else N), ternary, escape. Both mates take
    one alphabet, or none: it takes the same depleted base in both (a missing second mate has the first one's) and a ratio under 0.05."""
    _, call = _evidence(reads, reference, explicit)
    c = F.col
    second = F.when(sum((c(f"r2_{b}") for b in "cgt"), c("r2_a")) == 0, c("r1_bisulfite.base")).otherwise(c("r2_bisulfite.base"))
    least = lambda hit, other: F.least(*[depletion(c(f"{m}_{hit}"), c(f"{m}_{other}")) for m in ("r1", "r2")])
    on = ((least("c", "t") < 0.05) | (least("g", "a") < 0.05)) & (c("r1_bisulfite.base") == second) & second.isin("C", "G")
    base = F.when(on, second).otherwise("N")
    return call.select("assay", c("detail").alias("confidence"), base.alias("depleted_1"), base.alias("depleted_2"), on.alias("ternary"), F.when(on, second).otherwise("C").alias("escape"))


def adapter_activation(reads: DataFrame) -> DataFrame:
    """One row: eligible reads (without N), bases that stripping would take, and whether it is worth it. Decided once, for all reads."""
    own = reads.where(~seq.has_n(F.col("seq"))).agg(F.count("*").alias("eligible"), F.coalesce(F.sum(tails.adapter_info(F.col("seq"))["overlap"]), F.lit(0)).cast("long").alias("stripped"))
    return own.withColumn("active", (F.col("eligible") >= tails.SAMPLE_READS) & (F.col("stripped") >= tails.SAMPLE_BASES * F.col("eligible")))
