"""Quality rules on counts of words, symbols and lines, and on repeats found by suffix arrays.

All suffixes of the words of a batch of texts are ranked by prefix doubling (numpy, a text's suffixes among
themselves). The ranks of each doubling step stay, so the longest common prefix of neighbours in the suffix
array is read from them in a logarithmic number of steps. A suffix starts a repeated substring whose length is
its deepest interval of longest common prefixes: the larger value beside it. The spans of all maximal repeats
of a least length are united; a text fails if they cover too much of it, or if one repeat is too long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.text import slices

#: The symbols that count as such.
SYMBOLS = b"#*$%&|<>"
#: Words of a window for n_repeat_words; least words; greatest share of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 0.20
#: Least words of a repeat that counts as covering; greatest covered share; most words of one repeat.
LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT = 8, 0.20, 50

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def repeats(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``codes``: word numbers of several texts, one after another; ``doc``: ascending number of each word's text.
    For each position, the length in words of the longest substring that starts there and starts at another
    position of the same text too."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    end = np.searchsorted(doc, doc, side="right")
    # rank: the place of the first suffix of the group; at step 0 suffixes are in a group by text and first word
    order = np.lexsort((codes, doc))
    same = (codes[order][1:] == codes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, step = [rank], 1
    open_ = _in_groups(rank, np.arange(n))
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[open_]
        o = np.lexsort((second, first))
        a, b = first[o], second[o]
        new_group = np.concatenate([[True], a[1:] != a[:-1]])
        new_part = new_group | np.concatenate([[True], b[1:] != b[:-1]])
        at = np.arange(len(o))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[open_[o]] = a + part_start - group_start
        levels.append(rank)
        step *= 2
        open_ = _in_groups(rank, open_)
    suffixes = np.argsort(rank, kind="stable")
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[near].copy(), right[near].copy()
    common, stop = np.zeros(len(near), np.int64), end[i]
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        inside = (a < stop) & (b < stop)
        equal = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common += equal * (1 << k)
    np.maximum.at(longest, i, common)
    np.maximum.at(longest, j, common)
    return longest


def _in_groups(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of ``at`` that share their rank with another."""
    count = np.bincount(rank[at], minlength=len(rank))
    return at[count[rank[at]] > 1]


def covered(length: np.ndarray) -> np.ndarray:
    """Whether each position lies in a span that starts at i and has length[i] words (0: none)."""
    n = len(length)
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(length)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length[starts], n), -1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[bytes], window: int = WINDOW, least: int = LEAST_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text; see ``measures``."""
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n_words.sum())
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), n_words)
    length = repeats(codes, doc)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    first = np.cumsum(n_words) - n_words

    def by_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flag], minlength=len(texts)).astype(np.int64)

    best = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(n_words)
    if len(some):
        best[some] = np.maximum.reduceat(length, first[some])
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > 1:
            worded = [x for x in lines if x.split(None, 1)]
            dup[i] = len(worded) - len(set(worded))
    return {
        "n_words": n_words,
        "word_chars": np.array([int((_STARTS_CHAR[r] & ~_IS_SPACE[r]).sum()) for r in raw], np.int64),
        "n_symbols": np.array([int(_IS_SYMBOL[r].sum()) for r in raw], np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": by_text(covered(np.where(length >= window, window, 0))),
        "n_covered": by_text(covered(np.where(length >= least, length, 0))),
        "longest_repeat": best,
    }


def measures(df: DataFrame, text: str = "text", window: int = WINDOW, least: int = LEAST_REPEAT) -> DataFrame:
    """Adds to every row: n_words; word_chars, the code points in words; n_symbols; n_dup_lines, the lines with a
    word that equal an earlier line; n_repeat_words, the words in windows of ``window`` words that stand twice or
    more in the text; n_covered, the words in maximal repeated substrings of ``least`` words or more; and
    longest_repeat, the words of the longest repeated substring (all long). Occurrences may overlap.

    A null text counts as an empty one: zeros. Every row stays, repeated rows too; columns of these names are
    replaced. No shuffle; memory is bounded by an Arrow batch and the longest text."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.LongType(), False) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "__text", 2 << 20):
                got = measure([t or b"" for t in texts], window, least)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(got[c]) for c in new)], names=[*kept, *new])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def verdict(measured: DataFrame, least_words: int = LEAST_WORDS, most_repeated: float = MOST_REPEATED, most_covered: float = MOST_COVERED, longest: int = LONGEST_REPEAT) -> DataFrame:
    """Adds base_failed (too few words, or too large a share of repeated words) and kept: false if base_failed, if
    maximal repeats cover more than ``most_covered`` of the words, or if one has more than ``longest`` words."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > round(100 * most_repeated) * F.col("n_words"))
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return measured.withColumns({"base_failed": base, "kept": ~base & fine})


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``df``."""
    return verdict(measures(df.select("*", F.struct("*").alias("__row")), text)).where("kept").select("__row.*")
