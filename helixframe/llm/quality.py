"""A quality classifier on bytes: a small convolutional network in numpy.

Every byte is embedded, filters of WIDTH bytes run over the whole text in steps of STRIDE, and each filter's highest
response is taken in every chunk of CHUNK bytes (chunks overlap by the bytes that a filter reaches beyond its end). Over
all chunks of the text, each filter gives its mean and its highest response; these make one probability."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.text import slices

WIDTH, STRIDE, CHUNK, EMBED, FILTERS = 12, 4, 512, 4, 32
REACH = WIDTH - STRIDE
#: Labelled texts that the fit takes at most (whole, those with the least hashes of doc_id), bytes of text from which it takes no more of them, passes.
SAMPLE, SAMPLE_BYTES, PASSES = 3000, 64_000_000, 14
#: Chunks that the fit looks at together.
TOGETHER = 256
#: A document whose probability is below this is predicted 0.
THRESHOLD = 0.3
SEED = 11


def chunks_of(text: bytes) -> np.ndarray:
    """The overlapping chunks that cover the whole text, padded with zero bytes: (chunks, CHUNK + REACH)."""
    n = max(1, -(-len(text) // CHUNK))
    raw = np.zeros(n * CHUNK + REACH, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK + REACH)[::CHUNK]


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    bias: float

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED)"""
        x = self.embed[chunks].reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest response of each filter in each chunk, and its place."""
        w = self.windows(chunks)
        r = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(w.shape[0], w.shape[1], FILTERS)
        at = r.argmax(axis=1)
        return np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.shift, 0), at

    def highest(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), 256):
            w = self.windows(chunks[i : i + 256])
            r = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(w.shape[0], w.shape[1], FILTERS)
            out[i : i + 256] = np.maximum(r.max(axis=1) + self.shift, 0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        pooled = np.empty((len(texts), 2 * FILTERS), np.float64)
        held: list[np.ndarray] = []
        rows: list[tuple[int, int]] = []

        def flush() -> None:
            if rows:
                got = self.highest(np.concatenate(held))
                starts = np.cumsum([0, *(n for _, n in rows[:-1])])
                sizes = np.array([n for _, n in rows])[:, None]
                at = [i for i, _ in rows]
                pooled[at, :FILTERS] = np.add.reduceat(got, starts, axis=0, dtype=np.float64) / sizes
                pooled[at, FILTERS:] = np.maximum.reduceat(got, starts, axis=0)
                held.clear()
                rows.clear()

        waiting = 0
        for i, t in enumerate(texts):
            own = chunks_of(t)
            if len(own) > 4096:  # a very long text: its chunks go through in parts
                sums, most = np.zeros(FILTERS), np.zeros(FILTERS)
                for a in range(0, len(own), 4096):
                    got = self.highest(own[a : a + 4096])
                    sums += got.sum(axis=0, dtype=np.float64)
                    most = np.maximum(most, got.max(axis=0))
                pooled[i] = np.concatenate([sums / len(own), most])
                continue
            held.append(own)
            rows.append((i, len(own)))
            waiting += len(own)
            if waiting >= 2048:
                flush()
                waiting = 0
        flush()
        return 1 / (1 + np.exp(-(pooled @ self.weights + self.bias)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED, passes: int = PASSES) -> Network:
    """``texts``: the chunks of each. Adam on the log loss; filters that respond highest carry the gradient. Without labels, or with one label only,
    the network gives their smoothed share for every text."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32), (rng.normal(size=(WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return net
    net.weights = rng.normal(size=2 * FILTERS) * 0.1
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        state[name] = (m, v)
        return (value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(value.dtype)

    def parts(rows: np.ndarray) -> Iterator[np.ndarray]:
        """The chunks of the texts, one text after another, about TOGETHER of them in each part."""
        held: list[np.ndarray] = []
        for r in rows:
            for i in range(0, len(texts[r]), TOGETHER):
                held.append(texts[r][i : i + TOGETHER])
                if sum(map(len, held)) >= TOGETHER:
                    yield np.concatenate(held)
                    held = []
        if held:
            yield np.concatenate(held)

    size = 48
    for turn in range(passes):
        rate = 0.004 * (1 - turn / passes) + 0.0004
        order = rng.permutation(len(texts))
        for start in range(0, len(order), size):
            rows = order[start : start + size]
            step += 1
            n = np.array([len(texts[r]) for r in rows])
            starts = np.cumsum(n) - n
            own = np.repeat(np.arange(len(rows)), n)
            found = [net.responses(chunks) for chunks in parts(rows)]
            high, at = np.concatenate([h for h, _ in found]), np.concatenate([a.astype(np.int16) for _, a in found])
            del found
            mean = np.add.reduceat(high, starts, axis=0) / n[:, None]
            most = np.maximum.reduceat(high, starts, axis=0)
            z = np.concatenate([mean, most], axis=1).astype(np.float64)
            p = 1 / (1 + np.exp(-(z @ net.weights + net.bias)))
            d = (p - labels[rows]) / len(rows)
            dz = d[:, None] * net.weights
            d_filters = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
            d_embed = np.zeros((256, EMBED), np.float32)
            d_shift = np.zeros(FILTERS)
            done = 0
            for chunks in parts(rows):
                here = slice(done, done + len(chunks))
                done += len(chunks)
                of = own[here]
                dh = dz[of, :FILTERS] / n[of, None] + dz[of, FILTERS:] * (high[here] == most[of])
                dh *= high[here] > 0
                d_shift += dh.sum(axis=0)
                c, f = np.nonzero(dh)
                if not len(c):
                    continue
                g = dh[c, f].astype(np.float32)
                byte = chunks[c[:, None], at[here][c, f][:, None].astype(np.int64) * STRIDE + np.arange(WIDTH)]
                seen = net.embed[byte].reshape(len(c), -1)
                by = np.argsort(f, kind="stable")
                firsts = np.flatnonzero(np.concatenate([[True], f[by][1:] != f[by][:-1]]))
                d_filters[f[by][firsts]] += np.add.reduceat(seen[by] * g[by, None], firsts, axis=0)
                d_seen = (g[:, None] * net.filters.T[f]).reshape(-1, EMBED)
                flat = byte.ravel()
                d_embed += np.stack([np.bincount(flat, d_seen[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
            net.filters = adam("filters", net.filters, d_filters.T + 1e-5 * net.filters, rate)
            net.embed = adam("embed", net.embed, d_embed + 1e-5 * net.embed, rate)
            net.shift = adam("shift", net.shift, d_shift.astype(np.float32), rate)
            net.weights = adam("weights", net.weights, d @ z + 1e-4 * net.weights, rate * 2)
            net.bias = float(adam("bias", np.array(net.bias), np.array(d.sum()), rate * 2))
    return net


def held_out(doc_id, parts: int = 5, part: int = 0):
    """Whether a document is kept from the fit: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fits a network to the labels (doc_id, quality 0 or 1) of at most ``sample`` documents that aren't held out: those whose
    ids have the least hashes, whole texts, and of these as many as it takes to hold SAMPLE_BYTES, each (all rows of an id) no larger than that. Labels that are null are left out; of several labels for an
    id, the lowest counts. What comes to the driver is these texts."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # as many ids as the sample may have, so of a bounded size
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, held = [], 0
    for r in sizes:
        if held < SAMPLE_BYTES and r.bytes <= SAMPLE_BYTES:
            taken.append((r.doc_id,))
            held += r.bytes
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id")
    got = rows.select("doc_id", F.col("quality").cast("int"), F.col("text").cast("binary").alias("text")).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return fit([chunks_of(bytes(r.text)) for r in got], np.array([r.quality for r in got], np.float64))


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the probability (double) of label 1 for each whole text. Null texts are empty ones, which have a score too; every
    row stays; a column named ``out`` is replaced. No shuffle; the network (about 20 KB) goes along with the tasks."""
    kept = [c for c in (keep if keep is not None else df.columns) if c != out]
    passed = kept if text in kept else [*kept, text]  # the text goes along once
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(net.scores([t or b"" for t in texts]), pa.float64())], names=[*kept, out])

    return df.select(*[f"`{c}`" for c in passed]).mapInArrow(run, schema)


def keep_good(df: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is the threshold or more, with their columns."""
    return score(df, net, out="__score").where(F.col("__score") >= threshold).select(*[f"`{c}`" for c in df.columns])
