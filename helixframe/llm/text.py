"""Words, hashes and batches that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.scratch import ship

#: Python's bytes.split() cuts at exactly the characters that the word pattern excludes: \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once; a word that is longer is hashed alone.
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


@dataclass
class Words:
    """The words of several texts: hashes; the number of each one's text; bounds of each in ``raw``."""

    hashes: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: bytes
    bounds: np.ndarray  # the first word of each text, and the number of all words

    def text(self, first: int, end: int) -> str:
        """Words first .. end - 1, joined by one space."""
        return b" ".join(self.raw[self.starts[first] : self.ends[end - 1]].split()).decode()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, n)
    if size > _BLOCK:
        return _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    if not _POWERS:
        _POWERS[0] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return _POWERS[0]


def hash_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: list[Callable[[np.ndarray], np.ndarray]]) -> list[np.ndarray]:
    """By each of ``values`` (a fixed random number for each code), 64-bit hashes of the runs of codes: a polynomial of these numbers, and
    the run's length. Sums run along all codes, so that no run is touched on its own. Runs are ascending and apart, none is empty."""
    out = [np.empty(len(starts), np.uint64) for _ in values]
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _BLOCK, side="right")))
        n = int(ends[j - 1]) - at
        up, down = _tables(n)
        s, e = starts[i:j] - at, ends[i:j] - at
        for value, hashes in zip(values, out, strict=True):
            sums = np.cumsum(value(codes[at : at + n]) * up[:n])
            before = np.where(s > 0, sums[s - 1], np.uint64(0))
            hashes[i:j] = (sums[e - 1] - before) * down[s] + (e - s).astype(np.uint64) * _M2
        i = j
    return [mix(h) for h in out]


def hash_words(texts: list[bytes | None]) -> Words:
    """64-bit hashes of all words, of their bytes; see ``hash_runs``."""
    raw = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    doc = np.searchsorted(first, starts, side="right") - 1
    return Words(hash_runs(data, starts, ends, [_BYTE.__getitem__])[0], doc, starts, ends, raw, np.searchsorted(doc, np.arange(len(texts) + 1)))


_LOW = 0x2100
_SEEDS = (_GOLD, np.uint64(0xD6E8FEB86659FD93))
_LOW_CODES = [mix(np.arange(1, _LOW + 1, dtype=np.uint64) * seed) for seed in _SEEDS]


def _code_value(which: int) -> Callable[[np.ndarray], np.ndarray]:
    """A random number for each code point: from a table for the low ones."""

    def value(codes: np.ndarray) -> np.ndarray:
        out = _LOW_CODES[which][np.minimum(codes, _LOW - 1)]
        high = np.flatnonzero(codes >= _LOW)
        if len(high):
            out[high] = mix((codes[high].astype(np.uint64) + np.uint64(1)) * _SEEDS[which])
        return out

    return value


_CODE_VALUES = [_code_value(0), _code_value(1)]


def hash_codes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of 64 bits of each run of code points (uint32); see ``hash_runs``."""
    return hash_runs(codes, starts, ends, _CODE_VALUES)


def _polynomials(words: np.ndarray, k: int) -> np.ndarray:
    """sum(words[i + j] * GOLD ** (k - 1 - j)) for all i, from runs of half the length."""
    if k == 1:
        return words
    if k % 2:
        return _polynomials(words, k - 1)[:-1] * _GOLD + words[k - 1 :]
    half = _polynomials(words, k // 2)
    return half[: len(half) - k // 2] * np.uint64(pow(int(_GOLD), k // 2, 2**64)) + half[k // 2 :]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    return mix(_polynomials(words, k)) if len(words) >= k else np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch whose texts hold about ``limit`` bytes (one row at least), with the texts in UTF-8."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    start = held = 0
    out: list[bytes | None] = []
    for i in range(len(texts)):
        t = texts[i].as_py()
        out.append(t)
        held += len(t or b"")
        if held >= limit:
            yield batch.slice(start, i + 1 - start), out
            start, held, out = i + 1, 0, []
    if out:
        yield batch.slice(start), out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a string (long; null: 0), without an array of them: every word, with the white space around it, is made one character."""
    one = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.when(F.rlike(text, F.lit(WORD_PATTERN)), F.length(one)).otherwise(0).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


#: A character from U+0250 on. Below it, letters, numbers and white space are the following.
BEYOND = re.compile("[^\0-\u024f]")
_CLASSES = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts without a character BEYOND, in plain classes, which the standard library matches faster."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        for name, chars in _CLASSES.items():
            if pattern.startswith(name, i):
                out, i = out + (chars if inside else f"[{chars}]"), i + len(name)
                break
        else:
            if pattern.startswith(r"\S", i) and not inside:
                out, i = out + f"[^{_CLASSES[chr(92) + 's']}]", i + 2
                continue
            if pattern[i] == "\\":
                raise ValueError(f"no plain class for {pattern[i : i + 3]}")
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out, i = out + pattern[i], i + 1
    return re.compile(out)


class Known:
    """Number lists by pairs of 64-bit hashes, for the pairs met so far; ``limit`` pairs at most, all are given up when there are more."""

    def __init__(self, dtype, limit: int):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lists = Lists(self.dtype)

    def numbers(self, keys: np.ndarray, checks: np.ndarray, make) -> np.ndarray:
        """The number of the list of each pair, good until the next call. ``make(places)`` gives the lists, end to end, and their lengths for
        the places at which new pairs stand first."""
        if len(self.keys) > self.limit:
            self.clear()
        coded = pa.array(keys).dictionary_encode()
        own, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.empty(len(own), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        own_checks = checks[first]
        place = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        known = self.keys[place] == own if len(self.keys) else np.zeros(len(own), bool)
        if (own_checks[of] != checks).any() or (known & (self.checks[place] != own_checks if len(self.keys) else False)).any():
            raise ValueError("two strings have one hash")  # of 64 bits; the other 64 tell them apart
        numbers = np.empty(len(own), np.int64)
        numbers[known] = self.at[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            numbers[new] = self.lists.n + np.arange(len(new))
            self.lists.append(*make(first[new]))
            order = new[np.argsort(own[new])]
            where = np.searchsorted(self.keys, own[order])
            self.keys, self.checks, self.at = (np.insert(a, where, b[order]) for a, b in ((self.keys, own), (self.checks, own_checks), (self.at, numbers)))
        return numbers[of]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, that gives the memory of its task back to the system in the end: workers wait for further tasks beside others."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Numbered(dict):
    """Numbers of strings; those not seen before get the next numbers and are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Lists:
    """Number lists that are kept end to end, by their own numbers."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.ends = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.n = 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.flat.dtype)])
        while self.n + len(lengths) > len(self.ends):
            self.ends, self.lengths = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.ends, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths)
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.used += len(flat)
        self.n += len(lengths)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``at``, one after another, and their lengths."""
        lengths = self.lengths[at]
        where = np.repeat(self.ends[at] - np.cumsum(lengths), lengths)
        where += np.arange(len(where))
        return self.flat[where], lengths
