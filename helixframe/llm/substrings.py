"""Removal of passages that repeat what stands in an earlier document.

Which passages may repeat is found by hashes, and suffix automata decide:

1. Each window of WINDOW words has an anchor: the least hash of its runs of ANCHOR words. Anchors that stand in several
   documents go into a Bloom filter of bounded size; only windows whose anchor is in it go on, as segments of text.
2. The windows of these segments are counted by their own hashes, and each is told the first document that has it.
3. A document's passages that others repeat make it a reference shard: they are built into one suffix automaton, in front of
   the runs of windows that name it as their first document. These stream through the automaton, and their maximal matches of WINDOW words
   or more are the spans that are removed. A shard that many runs name is sent to several tasks, each with its part of the runs.

A hash may at most send a run to a document that doesn't have it, which the automaton sees."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.text import fresh, grams, hash_words, mix, slices
from helixframe.scratch import materialize, tables

WINDOW, ANCHOR = 13, 8
#: Runs that stream through one copy of an automaton, about.
RUNS = 256
#: Bits of a block of the Bloom filter; most blocks (64 MB in all); bits for each anchor below that; bits set for each.
BLOCK_BITS, MOST_BLOCKS, BITS_EACH, PROBES = 1 << 19, 1024, 16, 4


class SuffixAutomaton:
    """The suffix automaton of several passages of words; no match passes from one passage to another."""

    def __init__(self, passages: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for n, passage in enumerate(passages):
            for word in passage:
                last = self._extend(last, word)
            last = self._extend(last, n)  # a number is no word

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """For each word, the length of the longest match with a passage that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = l = 0
        for c in words:
            while v and c not in nxt[v]:
                v = link[v]
                l = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                l += 1
            yield l

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """The union of the maximal matches of ``least`` words or more, as (start, end)."""
        out: list[list[int]] = []
        for i, l in enumerate(self.matching(words)):
            if l >= least:
                if out and i - l + 1 <= out[-1][1]:
                    out[-1][0], out[-1][1] = min(out[-1][0], i - l + 1), i + 1
                else:
                    out.append([i - l + 1, i + 1])
        return [(a, b) for a, b in out]


def window_anchors(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows that lie in one text, and their anchors. ``words``: hashes of the words of several texts; ``doc``: each one's text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(words, k)
    least, span, width = g, 1, window - k + 1
    while span < width:  # minima of twice as many, or of as many as are missing
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return inside, least[inside]


def _anchors(rows: DataFrame) -> DataFrame:
    """anchor: each document's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                words = hash_words(texts)
                at, anchor = window_anchors(words.hashes, words.doc)
                d = words.doc[at]
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1])])) if len(at) else at
                a, d = anchor[first], d[first]
                o = np.lexsort((a, d))
                a, d = a[o], d[o]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]) if len(a) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64))], names=["anchor"])

    return rows.select("text").mapInArrow(run, "anchor long")


class Bloom:
    """Blocks of bits; each key has its bits in one block."""

    def __init__(self, blocks: int, bits: np.ndarray):
        self.blocks, self.bits = blocks, bits

    @staticmethod
    def places(keys: np.ndarray) -> Iterator[np.ndarray]:
        for j in range(PROBES):
            yield (mix(keys + np.uint64(j + 1)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = (keys & np.uint64(self.blocks - 1)).astype(np.int64) * BLOCK_BITS
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            at = base + p
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom(shared: DataFrame) -> Bloom:
    """A filter of the one long column of ``shared``; at most MOST_BLOCKS blocks come to the driver. With more values than it can tell apart, more
    rows pass than need to, and none is lost."""
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_BITS < BITS_EACH * shared.count():
        blocks *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block = (keys & np.uint64(blocks - 1)).astype(np.int64)
            for b in np.unique(block):
                own = keys[block == b]
                bits = held.setdefault(int(b), np.zeros(BLOCK_BITS // 8, np.uint8))
                for p in Bloom.places(own):
                    np.bitwise_or.at(bits, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for r in shared.repartition(F.col(shared.columns[0]).bitwiseAND(F.lit(blocks - 1))).mapInArrow(run, "block int, bits binary").toLocalIterator():
        bits[r.block * (BLOCK_BITS // 8) :][: BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return Bloom(blocks, bits)


_SEGMENT = "doc_id long, h long, start int, text string"


def _segments(rows: DataFrame, passing: Bloom) -> DataFrame:
    """The parts of each document whose windows all have an anchor in the filter: start (its first word), text."""
    known = rows.sparkSession.sparkContext.broadcast((passing.blocks, passing.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(*known.value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = hash_words(texts)
                at, anchor = window_anchors(words.hashes, words.doc)
                if not len(at):
                    continue
                new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                has = own.has(anchor[new])[np.cumsum(new) - 1]
                at = at[has]
                if not len(at):
                    continue
                d = words.doc[at]
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])]))
                first, end, of = at[cut], at[np.concatenate([cut[1:] - 1, [len(at) - 1]])] + WINDOW, d[cut]
                starts = first - words.bounds[of]
                text = [words.text(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                rows_of = part.select(["doc_id", "h"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*rows_of.columns, pa.array(starts.astype(np.int32)), pa.array(text)], names=["doc_id", "h", "start", "text"])

    return rows.select("doc_id", "h", "text").mapInArrow(run, _SEGMENT)


def _windows(segments: DataFrame) -> DataFrame:
    """w (the hash of a window), doc_id, seg, off (its place in the segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = hash_words(texts)
                w, doc, base = grams(words.hashes, WINDOW), words.doc, words.bounds
                at = np.flatnonzero(doc[: len(w)] == doc[WINDOW - 1 :]) if len(w) else np.zeros(0, np.int64)
                of = doc[at]
                for a in range(0, len(at), 1 << 18):
                    b = slice(a, a + (1 << 18))
                    ids = part.select(["doc_id", "seg"]).take(pa.array(of[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(w[at[b]].view(np.int64)), *ids.columns, pa.array((at[b] - base[of[b]]).astype(np.int32))], names=["w", "doc_id", "seg", "off"])

    return segments.select("doc_id", "seg", "text").mapInArrow(run, "w long, doc_id long, seg long, off int")


def _runs(told: DataFrame) -> DataFrame:
    """For each segment with what its windows were told: doc_id, h, ref (the document that has the run first), own (whether it's this
    one), start (in the document), text. Consecutive windows with one first document make a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                doc, words = c["doc_id"][i].as_py(), c["text"][i].as_py().encode().split()
                off = np.array(c["found"][i].values.field("off"))
                first = np.array(c["found"][i].values.field("first"))
                o = np.argsort(off, kind="stable")
                off, first = off[o], first[o]
                cut = np.flatnonzero(np.concatenate([[True], (off[1:] != off[:-1] + 1) | (first[1:] != first[:-1])])).tolist()
                for a, b in zip(cut, [*cut[1:], len(off)], strict=True):
                    s, e = int(off[a]), int(off[b - 1]) + WINDOW
                    rows.append((doc, c["h"][i].as_py(), int(first[a]), int(first[a]) == doc, c["start"][i].as_py() + s, b" ".join(words[s:e]).decode()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "h", "ref", "own", "start", "text"])

    return told.select("doc_id", "h", "start", "text", "found").mapInArrow(run, "doc_id long, h long, ref long, own boolean, start int, text string")


def _streams(runs: DataFrame, keep) -> DataFrame:
    """ref, part, own, doc_id, h, start, text: the passages of each shard (own), then the runs that name it, in one stream for each of its parts: as
    many as it takes for about RUNS runs each."""
    asking = runs.where("not own")
    asked = keep(asking.groupBy("ref").agg(F.ceil(F.count("*") / RUNS).cast("int").alias("parts")), "asked")
    of = F.pmod(F.xxhash64("doc_id", "h", "start"), F.col("parts")).cast("int")
    asking = asking.join(asked.hint("merge"), "ref").select("ref", of.alias("part"), "own", "doc_id", "h", "start", "text")
    shards = runs.where("own").join(asked.hint("merge"), "ref").select("ref", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own", "doc_id", "h", "start", "text")
    return shards.unionByName(asking).repartition("ref", "part").sortWithinPartitions("ref", "part", F.desc("own"))


def _matched(streams: DataFrame) -> DataFrame:
    """doc_id, h, start, end of the maximal matches of each run with its reference shard. In a stream the passages come first: the
    automaton is built of them when the first run comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, None
        passages: dict[bytes, None] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, here in enumerate(zip(c["ref"].to_pylist(), c["part"].to_pylist(), strict=True)):
                if here != at:
                    at, automaton, passages = here, None, {}
                if c["own"][i].as_py():
                    passages[c["text"][i].as_py().encode()] = None
                    continue
                if automaton is None:
                    automaton, passages = SuffixAutomaton([p.split() for p in passages]), {}
                for a, b in automaton.spans(c["text"][i].as_py().encode().split(), WINDOW):
                    start = c["start"][i].as_py()
                    for column, value in zip(out, (c["doc_id"][i].as_py(), c["h"][i].as_py(), start + a, start + b), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "h", "start", "end"])

    return streams.mapInArrow(run, "doc_id long, h long, start int, end int")


def with_spans(df: DataFrame, out: str = "spans") -> DataFrame:
    """Adds ``out`` (array of struct<start, end>, in words; null: none): each word of the text that is covered by a window of
    WINDOW words whose words also stand, in this order, in a document with a smaller doc_id. Texts are judged as they are
    given, not by what is left of them. ``df`` has doc_id and text; a column named as ``out`` is replaced.

    Null texts have no words. Rows with a null doc_id aren't compared with others. Rows that share a doc_id don't count as
    earlier than each other. Every row stays; an empty table gives an empty one.

    Hot windows are summed up before the shuffle; in the joins, adaptive execution splits keys with many rows; a document that many others
    repeat is dealt to several tasks. A task holds one document's passages at a time."""
    kept = [c for c in df.columns if c != out]
    h = F.xxhash64(F.col("text").cast("string"))
    rows = df.select(F.col("doc_id").cast("long"), h.alias("h"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with tables(df.sparkSession, "substrings") as keep:
        found = materialize(_spans(rows, keep), "spans")
    (key,) = fresh(df, "k")
    own = found.select(F.struct("doc_id", "h").alias(key), F.col("spans").alias(out))
    marked = df.select(*[F.col(f"`{c}`") for c in kept], F.struct(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h")).alias(key))
    return marked.join(own.hint("merge"), key, "left").select(*[F.col(f"`{c}`") for c in kept], out)


def _spans(rows: DataFrame, keep) -> DataFrame:
    """doc_id, h, spans for the rows (doc_id, h, text) that have any."""
    shared = keep(_anchors(rows).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    segments = keep(_segments(rows, bloom(shared)).withColumn("seg", F.monotonically_increasing_id()), "segments")
    windows = _windows(segments)
    first = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = keep(first, "windows")  # read back, so that the join's two sides are plain shuffles, which hot windows can be split in
    found = windows.drop("doc_id").join(first.hint("merge"), "w").groupBy("seg").agg(F.collect_list(F.struct("off", "first")).alias("found"))
    runs = keep(_runs(segments.join(found.hint("merge"), "seg")), "runs")
    return _matched(_streams(runs, keep)).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _kept(text: bytes, spans: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """The number of words, and the runs of words that stay, as (start, end)."""
    n = len(text.split())
    out, at = [], 0
    for s in spans:
        if s["start"] > at:
            out.append((at, s["start"]))
        at = max(at, s["end"])
    if at < n:
        out.append((at, n))
    return n, out


def removed(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows: tuple[list, ...] = ([], [], [])
                for t, spans in zip(texts, part.column(2).to_pylist(), strict=True):
                    words = (t or b"").split()
                    runs = _kept(t or b"", spans)[1] if spans else [(0, len(words))]
                    kept = [w for a, b in runs for w in words[a:b]]
                    for column, value in zip(rows, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, rows)] if rows[0] else [], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = with_spans(df.select("doc_id", F.col("text").cast("string").alias("text")))
    return out.mapInArrow(run, T.StructType([out.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the spans: what stays keeps its white space, and a space stands for each span between."""
    at = [m.span() for m in _WORD.finditer(text)]
    return b" ".join(text[at[a][0] : at[b - 1][1]] for a, b in _kept(text, spans)[1])


def dedup(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with the repeated passages cut from text (n_chars, where there is one, is made anew); a document that repeats
    earlier ones throughout leaves an empty text. All other texts stay as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                out = [t if not s else cut(t, s) for t, s in zip(texts, part.column(len(names)).to_pylist(), strict=True)]
                strings = [None if t is None else t.decode() for t in out]
                columns = []
                for i, c in enumerate(names):
                    if c == "text":
                        columns.append(pa.array(strings, pa.string()))
                    elif c == "n_chars":
                        columns.append(pa.array([None if t is None else len(t) for t in strings], part.column(i).type))
                    else:
                        columns.append(part.column(i))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return with_spans(df, *fresh(df, "spans")).mapInArrow(run, df.schema)
