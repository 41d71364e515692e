"""Byte-level BPE: encoding by length-bucketed padded matrices in numpy, and exact decoding.

Texts are split into the matches of the token pattern, and each distinct match is encoded once for each task while it
is kept; matches are told apart by hashes. New matches are merged together: those of similar length stand in the rows of one padded matrix, each
round merges in every row the leftmost pair of least rank, ranks come from a hash table of pairs, and rows without
a pair leave the matrix."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.text import BEYOND, Known, Lists, hash_codes, latin_pattern, mix, slices, tidy

NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank of the token that two tokens make together: an open-addressing hash table in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys, values = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        at = mix(keys) & self.mask
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == np.uint64(2**64 - 1)]
            slot, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the pair isn't a token or either side is negative (padding)."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(key.shape, NONE, np.int32)
        at = mix(key) & self.mask
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.probes):
            slot = at[todo]
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            if not len(todo):
                break
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        return out


class Vocabulary:
    """What the file of a vocabulary (lines "base64(token) rank" that hold every single byte) says: ranks of pairs, ids of bytes, bytes of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.bytes = Lists(np.uint8)
        self.bytes.append(np.frombuffer(b"".join(self.tokens), np.uint8), np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One for each worker process; nothing that has been encoded is kept with it."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Codec:
    """``vocabulary``: the path of its file; ``pattern``: the token pattern, in the syntax of the regex library.

    About ``kept`` distinct matches stay encoded, in some 40 bytes each; ``cells`` bounds a padded matrix."""

    def __init__(self, vocabulary: str, pattern: str, kept: int = 1_000_000, cells: int = 1 << 18):
        own = vocabulary_of(vocabulary)
        self.pairs, self.byte_ids, self.tokens, self.bytes, self.cells = own.pairs, own.byte_ids, own.tokens, own.bytes, cells
        self.pattern = regex.compile(pattern)
        try:
            self.latin = latin_pattern(pattern)
        except ValueError:  # the regex library alone then
            self.latin = self.pattern
        self.known = Known(np.int32, kept)

    # -- merging ---------------------------------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the byte strings, each merged as one match, one after another; and how many ids each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while start < len(order):
            # a bucket: lengths up to a quarter over the shortest, and no more cells than the bound
            least = int(sizes[order[start]])
            end = int(np.searchsorted(sizes[order], least + least // 4, side="right"))
            width = int(sizes[order[end - 1]])
            end = min(end, start + max(1, self.cells // width))
            rows = order[start:end]
            for own, ids, size in self._merge_bucket([words[i] for i in rows]):
                counts[rows[own]] = size
                parts.append((rows[own], ids))
            start = end
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, ids in parts:
            n = counts[rows]
            flat[np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _merge_bucket(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their ids, their numbers of ids) as rows come to their end."""
        width = max(map(len, words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        row = np.arange(len(words))
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        while True:
            if rank.shape[1]:
                best = rank.argmin(axis=1)
                least = rank[np.arange(len(row)), best]
                done = least == NONE
            else:
                done = np.ones(len(row), bool)
            if done.any():
                ended = ids[done]
                yield row[done], ended[ended >= 0], size[done]
                keep = ~done
                if not keep.any():
                    return
                row, size, best, least = row[keep], size[keep], best[keep], least[keep]
                width = int(size.max())
                ids, rank = ids[keep, :width], rank[keep, : width - 1]
            ids, rank, size = self._round(ids, rank, size, best, least)

    def _round(self, ids, rank, size, best, least):
        """Merges the leftmost pair of least rank in every row. A row where that pair stands several times takes
        all of them in the same round if no merge on the way makes a pair of lower rank: one after another, the
        rounds would take just these."""
        n, width = ids.shape
        rows = np.arange(n)
        take = np.zeros((n, width), bool)  # take[r, i]: the pair at i, i + 1 is merged
        take[rows, best] = True
        same = rank == least[:, None]
        many = np.flatnonzero(same.sum(axis=1) > 1)
        if len(many):
            some = self._together(ids[many], same[many], least[many])
            take[many, : width - 1] |= some
        gone = np.zeros((n, width), bool)
        gone[:, 1:] = take[:, :-1]
        ids = np.where(take, least[:, None], ids)
        kept = ~gone
        to = np.cumsum(kept, axis=1) - 1
        size = size - take.sum(axis=1)
        width = max(1, int(size.max()))
        valid = kept & (ids >= 0)
        r, c = np.nonzero(valid)
        new = np.full((n, width), -1, np.int32)
        new[r, to[r, c]] = ids[r, c]
        if width == 1:
            return new, np.zeros((n, 0), np.int32), size
        # ranks move along with their left token; those beside a merged token are looked up anew
        new_rank = np.full((n, width), NONE, np.int32)
        held = np.full((n, ids.shape[1]), NONE, np.int32)
        held[:, : rank.shape[1]] = rank
        new_rank[r, to[r, c]] = held[r, c]
        fresh = np.zeros((n, width + 1), bool)
        mr, mc = np.nonzero(take)
        at = to[mr, mc]
        fresh[mr, at + 1] = True  # shifted by one: column i + 1 stands for the pair at i
        fresh[mr, at] = True
        fr, fc = np.nonzero(fresh[:, 1:width])
        new_rank[fr, fc] = self.pairs.find(new[fr, fc], new[fr, fc + 1])
        return new, new_rank[:, : width - 1], size

    def _together(self, ids, same, least):
        n, width = ids.shape
        take = np.zeros((n, width - 1), bool)
        before = np.zeros(n, bool)
        runs = same.copy()
        runs[:, 1:] &= ~same[:, :-1]
        alternate = same[:, 1:] & same[:, :-1]
        if alternate.any():  # aaaa: every second pair of a run, from its start
            for i in range(width - 1):
                take[:, i] = same[:, i] & ~before
                before = take[:, i]
        else:
            take = runs
        r, c = np.nonzero(take)
        made = least[r]
        merged_before = np.zeros(len(r), bool)
        merged_before[1:] = (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 2)
        left = np.where(c > 0, ids[r, np.maximum(c - 1, 0)], -1)
        left = np.where(merged_before, made, left)
        right = np.where(c + 2 < width, ids[r, np.minimum(c + 2, width - 1)], -1)
        low = np.minimum(self.pairs.find(left, made), self.pairs.find(made, right)) < made
        bad = np.zeros(n, bool)
        bad[r[low]] = True
        take[bad] = False
        return take

    # -- texts -----------------------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        found = [(self.pattern if BEYOND.search(t) else self.latin).findall(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        lengths = np.fromiter(map(len, chain.from_iterable(found)), np.int64, int(counts.sum()))
        joined = "".join(chain.from_iterable(found))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(lengths)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if (empty := lengths == 0).any():  # a pattern may match nothing
            bounds = bounds - np.concatenate([[0], np.cumsum(empty)])[bounds]
            lengths, ends = lengths[~empty], ends[~empty]
        keys, checks = hash_codes(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends - lengths, ends)

        def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.merge([joined[b - n : b].encode() for b, n in zip(ends[places].tolist(), lengths[places].tolist(), strict=True)])

        flat, sizes = self.known.lists.gather(at) if len(at := self.known.numbers(keys, checks, make)) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of several lists of ids, end to end, and how many bytes each list has; ValueError for an id that the vocabulary doesn't have."""
        bad = (ids < 0) | (ids >= len(self.tokens))
        bad[~bad] = self.bytes.lengths[ids[~bad]] == 0
        if bad.any():
            raise ValueError(f"id {ids[bad][0]} is not in the vocabulary of {len(self.tokens)}")
        flat, sizes = self.bytes.gather(ids)
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids) -> bytes:
        own = np.asarray(ids, np.int64)
        return self.decode_batch(own, np.array([len(own)]))[0].tobytes()


def codec(vocabulary: str, pattern: str) -> Codec:
    """A codec for a task; the vocabulary is read once for each worker process."""
    return Codec(vocabulary, pattern)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(_offsets(counts)), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Adds the column ``ids`` (array<int>) with the ids of the whole text, and, where ``decoded`` names a column, in it the bytes that these ids are
    decoded to (binary): columns of these names are replaced. ``keep`` lists the columns that stay (default: all). A null text
    is encoded as an empty one: no ids. Every row is kept, repeated rows too; an empty table gives an empty one.

    Needs no shuffle; memory is bounded by an Arrow batch (64 MB), the matches that are kept (40 MB) and the longest text."""
    new = [ids, *([decoded] if decoded else [])]
    kept = [c for c in (keep if keep is not None else df.columns) if c not in new]
    passed = kept if text in kept else [*kept, text]  # the text goes along once
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            for part, texts in slices(batch, text, 1 << 20):
                flat, counts = own.encode_batch([(t or b"").decode() for t in texts])
                columns = [pa.ListArray.from_arrays(pa.array(_offsets(counts)), pa.array(flat))]
                if decoded:
                    columns.append(_binary(*own.decode_batch(flat, counts)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*kept, *new])

    return df.select(*[f"`{c}`" for c in passed]).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the column ``out`` (binary) with the bytes that the ids stand for; null ids give null. All other columns stay.
    Ids outside the vocabulary fail."""
    others = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(out, T.BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            step = 512
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column(others.index(ids))
                counts = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                flat, sizes = own.decode_batch(np.array(lists.flatten(), np.int64), counts)
                values = pc.if_else(lists.is_valid(), _binary(flat, sizes), None)
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*others, out])

    return df.select(*[f"`{c}`" for c in others]).mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))
