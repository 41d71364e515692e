"""Column functions on bases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

K = 17


def has_n(seq: Column) -> Column:
    """Whether there is an upper-case N; a lower-case one doesn't count."""
    return F.contains(seq, F.lit("N"))


def has_non_acgtn(seq: Column) -> Column:
    """Whether a character is none of ACGTN in either case; CR, LF and space don't count."""
    return F.rlike(seq, F.lit("[^ACGTNacgtn\r\n ]"))


def upper_bases(seq: Column) -> Column:
    return F.upper(seq)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def kmers(seq: Column, step: int, k: int = K) -> Column:
    """Every ``step``-th run of k bases, from the first; runs with a character other than ACGT are left out, short reads have none."""
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - (k - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.upper(F.substring(seq, i, F.lit(k)))), lambda w: ~F.rlike(w, F.lit("[^ACGT]")))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement: in alphabet order, which is the order of their 2-bit codes."""
    return F.least(kmer, reverse_complement(kmer))


def kmer_code(kmer: Column) -> Column:
    """The 2-bit codes of a k-mer's bases (A, C, G, T: 0 to 3), the first one in the highest bits."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_of(code: Column, k: int = K) -> Column:
    """The inverse of ``kmer_code``."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2


def batch_codes(texts: pa.Array, step: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For a batch of sequences: the place in the batch and the ``kmer_code`` of each canonical k-mer, as ``kmers`` and ``canonical`` have them."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.not_equal(pc.utf8_length(texts), pc.binary_length(texts))).as_py():  # a character is one place
        texts = pa.array([t.encode("ascii", "replace") for t in texts.to_pylist()], pa.binary())
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    letters = _CODES[np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)]
    n = np.where(lengths >= k, (lengths - k) // step + 1, 0)
    place = np.repeat(np.arange(len(n)), n)
    start = (np.cumsum(lengths) - lengths)[place] + step * (np.arange(len(place)) - (np.cumsum(n) - n)[place])
    own, other, good = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.ones(len(place), bool)
    for j in range(k):
        base = letters[start + j].astype(np.int64)
        good &= base < 4
        own = own << 2 | base & 3
        other |= (3 - base & 3) << 2 * j
    return place[good], np.minimum(own, other)[good]


def depleted_key(key: Column, base: str) -> Column:
    """A key in which a depleted base is as good as the one that it turns into: C as T, or G as A."""
    return F.translate(key, base, {"C": "T", "G": "A"}[base])


def strict_number(text: Column, kind: str) -> Column:
    """The number that the whole string is, else null."""
    pattern = {"int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"}[kind]
    return F.when(F.rlike(text, F.lit(pattern)), text.try_cast(kind))


def semver(text: Column) -> Column:
    """struct<major, minor, patch> of major.minor[.patch]; null for anything else."""
    part = lambda i: F.coalesce(F.get(F.split(text, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.rlike(text, F.lit(r"^\d+\.\d+(\.\d+)?$")), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))
