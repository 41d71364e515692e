"""Column functions that take read ends apart and put them together again exactly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The transposase adapters, in the order in which they are looked for, and the least overlap.
ADAPTERS, LEAST_OVERLAP = ("CTGTCTCTTATACACATCT", "AGATGTGTATAAGAGACAG"), 12
#: A run of one base at the end counts from one more than this.
TAIL_OVER = 20
#: Activation of adapter stripping: least reads without N, and least stripped bases for each of them.
SAMPLE_READS, SAMPLE_BASES = 1024, 1.0


def polyat(seq: Column) -> Column:
    """The run of over TAIL_OVER A or T, in either case, at the end; empty if there is none."""
    return F.regexp_extract(F.upper(seq), rf"(A{{{TAIL_OVER + 1},}}|T{{{TAIL_OVER + 1},}})$", 1)


#: Line ends that a pattern's end may stand before (fixed values).
_LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")


def has_polyat(seq: Column) -> Column:
    """Whether ``polyat`` finds a tail; only a read with a line end at its end is searched."""
    upper = F.upper(seq)
    ends = F.endswith(upper, F.lit("A" * (TAIL_OVER + 1))) | F.endswith(upper, F.lit("T" * (TAIL_OVER + 1)))
    return F.when(F.substring(seq, -1, 1).isin(*_LINE_ENDS), F.length(polyat(seq)) > 0).otherwise(ends)


def polyat_info(seq: Column) -> Column:
    """struct<len, base>"""
    tail = polyat(seq)
    return F.struct(F.length(tail).alias("len"), F.substring(tail, 1, 1).alias("base"))


def strip(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def polyat_restore(seq: Column, info: Column) -> Column:
    return F.concat(seq, F.repeat(info["base"], info["len"]))


def adapter_info(seq: Column) -> Column:
    """struct<adapter, overlap> of the first adapter whose head, of the longest overlap down to LEAST_OVERLAP, ends the read; 0 bases
    where there is none."""
    cases = [(i, n) for i, a in enumerate(ADAPTERS) for n in range(len(a), LEAST_OVERLAP - 1, -1)]
    none = F.struct(F.lit(-1).alias("adapter"), F.lit(0).alias("overlap"))
    upper = F.upper(seq)
    found = lambda i, n: F.struct(F.lit(i).alias("adapter"), F.lit(n).alias("overlap"))
    return reduce(lambda rest, c: F.when(F.endswith(upper, F.lit(ADAPTERS[c[0]][: c[1]])), found(*c)).otherwise(rest), reversed(cases), none)


def has_adapter(seq: Column) -> Column:
    """Whether ``adapter_info`` finds one."""
    upper = F.upper(seq)
    return reduce(lambda a, b: a | b, [F.endswith(upper, F.lit(a[:n])) for a in ADAPTERS for n in range(LEAST_OVERLAP, len(a) + 1)])


def adapter_restore(seq: Column, info: Column) -> Column:
    """The read with its adapter's head; an overlap that no adapter has fails."""
    head = F.when(info["adapter"] == 0, F.substring(F.lit(ADAPTERS[0]), F.lit(1), info["overlap"])).when(info["adapter"] == 1, F.substring(F.lit(ADAPTERS[1]), F.lit(1), info["overlap"]))
    good = (info["adapter"].isin(0, 1) & info["overlap"].between(LEAST_OVERLAP, len(ADAPTERS[0]))) | ((info["adapter"] == -1) & (info["overlap"] == 0))
    return F.when(good, F.concat(seq, F.coalesce(head, F.lit("")))).otherwise(F.raise_error(F.concat(F.lit("no such adapter overlap: "), info["overlap"].cast("string"))).cast("string"))


def barcode(text: Column, n: int) -> Column:
    """The first n characters; a shorter read fails."""
    return F.when(F.length(text) >= n, F.substring(text, 1, n)).otherwise(F.raise_error(F.concat(F.lit(f"a read is shorter than its barcode of {n}: "), text)).cast("string"))


def after_barcode(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(n + 1), F.length(text))


def may_strip_barcodes(assay: str, confidence: str, long_reads: bool, keeps_order: bool, length: int, length_given: bool, kept_elsewhere: bool = False, note: str = "") -> bool:
    """Whether the first bases of R1 are stripped as barcodes: single-cell RNA, short reads that keep their order, barcodes that no other file has, neither the
    index lanes nor the third one. The assay is set by hand, or it is sure and so is the length."""
    if assay != "sc-rna" or long_reads or not keeps_order or kept_elsewhere or length == 0 or "index-group" in note or "read3-group" in note:
        return False
    return confidence == "N/A" or (length_given and confidence.startswith("high"))


def may_strip_tails(assay: str, confidence: str, long_reads: bool, keeps_order: bool) -> bool:
    """Whether poly-A and poly-T tails are stripped: RNA, sure or set by hand, short reads whose order is given up."""
    return assay in ("rna", "sc-rna") and not long_reads and not keeps_order and (confidence == "N/A" or confidence.startswith("high"))


def may_strip_adapters(assay: str, confidence: str, long_reads: bool, fasta: bool, lane: str) -> bool:
    """Whether adapters are looked for: ATAC, sure or set by hand, short FASTQ reads, and no index or third lane."""
    return assay in ("atac", "sc-atac") and not long_reads and not fasta and lane in ("R1", "R2") and (confidence == "N/A" or confidence.startswith("high"))
