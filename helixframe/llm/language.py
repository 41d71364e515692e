"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

The n-grams (1 to 4 letters, with word bounds) are hashed to a fixed number of features. Document frequencies are
counted over all documents to learn from; the weights are fitted to a bounded sample of these with the
follow-the-regularised-leader rule and an elastic net, which leaves most of them zero; a temperature, found on a
part of the sample that the fit doesn't see, calibrates the probabilities. A document's score is a sum over its words,
so each distinct word is looked at once while it is kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.quality import held_out
from helixframe.llm.text import Lists, Numbered, mix, slices

FEATURES, LONGEST = 1 << 17, 4
#: Documents that the fit takes at most (those with the least hashes of doc_id); passes; the share of them for the temperature.
SAMPLE, PASSES, APART = 3000, 4, 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.0005
#: Features of a document are its n-grams' frequencies times their idf, times this.
SCALE = 20.0
KEPT = 300_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each lower-case word, one after another, and how many there are of each. What isn't a letter bounds
    an n-gram: it may stand at its ends only, and beside a letter."""
    joined = " " + " ".join(words) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(cp == 32) - 1
    letter = _letters()[cp]
    code = np.where(letter, cp, 0).astype(np.uint64)
    found_at, found = [], []
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        last = len(code) - n + 1
        good = np.ones(last, bool)
        for j in range(1, n - 1):
            good &= letter[j : j + last]
        good &= letter[:last] if n == 1 else (letter[:last] | letter[n - 1 :]) if n == 2 else good
        h = np.full(last, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : j + last]
        at = np.flatnonzero(good)
        # an n-gram that starts at the bound before a word is that word's
        first_letter = np.where(letter[at], at, at + 1) if n > 1 else at
        found_at.append(word[np.minimum(first_letter, len(word) - 1)])
        found.append((mix(h[at]) % np.uint64(FEATURES)).astype(np.int32))
    at, ids = np.concatenate(found_at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return ids[order], np.bincount(at[order], minlength=len(words))[: len(words)].astype(np.int64)


class Grams:
    """The n-grams of words, kept while there are about KEPT of these."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index, self.ids = Numbered(), Lists(np.int32)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The word numbers of all texts, how many words each has, and whether old numbers were given up."""
        fresh = len(self.index) > KEPT
        if fresh:
            self.clear()
        words = [t.lower().split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if new := self.index.new:
            self.ids.append(*features(new))
            self.index.new = []
        return at, counts, fresh

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.ids.gather(at)[0]


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # features with a weight
    weights: np.ndarray  # (rows, languages): weights times idf times SCALE
    bias: np.ndarray
    temperature: float

    def table(self) -> np.ndarray:
        out = np.zeros((FEATURES, max(1, len(self.languages))), np.float32)
        if self.languages:
            out[self.rows] = self.weights
        return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature stands, over all of them; at most FEATURES sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, n = Grams(), np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for _, texts in slices(batch, "text"):
                at, counts, _ = grams.numbers([(t or b"").decode() for t in texts])
                ends = np.cumsum(counts)
                for a, b in zip(ends - counts, ends, strict=True):
                    df[np.unique(grams.of(np.unique(at[a:b])))] += 1
                n += len(texts)
        df[FEATURES] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["feature", "n"])

    got = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[got["feature"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:FEATURES], int(df[FEATURES])


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], languages: list[str], passes: int = PASSES, seed: int = 5) -> Model:
    """``examples``: features and values of each document. Every APART-th example is kept for the temperature."""
    k = len(languages)
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    bias = np.zeros(k)
    rng = np.random.default_rng(seed)

    def weights(rows: np.ndarray) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    fitted = [i for i in range(len(examples)) if i % APART or len(examples) < 2 * APART]
    apart = [i for i in range(len(examples)) if not i % APART]
    for _ in range(passes):
        for i in rng.permutation(fitted):
            rows, x = examples[i]
            w = weights(rows)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            old = n[rows]
            n[rows] = old + g * g
            z[rows] += g - (np.sqrt(n[rows]) - np.sqrt(old)) / ALPHA * w
            bias -= 0.02 * p
    w = weights(np.arange(FEATURES))
    scores = np.array([examples[i][1] @ w[examples[i][0]] + bias for i in apart]).reshape(len(apart), k)
    truth = np.array([labels[i] for i in apart], np.int64)
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        s = scores / t
        loss = (np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(truth)), truth]).mean() if len(truth) else abs(np.log(t))
        best = min(best, (float(loss), float(t)))
    rows = np.flatnonzero(np.abs(w).max(axis=1)) if k else np.zeros(0, np.int64)
    return Model(languages, rows, w[rows], bias, best[1])


def _sampled(known: DataFrame, sample: int) -> DataFrame:
    """Rows of the least hashes within each language: an equal share of ``sample`` each. A threshold for each language, of twice its share, leaves few rows to be
    ordered; a language that has less than that keeps all. Equal rows count once."""
    counts = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    each = max(1, sample // max(1, len(counts)))
    shares = known.sparkSession.createDataFrame([(lang, min(1.0, (2 * each + 20) / n)) for lang, n in counts], "lang string, share double")
    h = F.xxhash64("doc_id", "text")
    some = known.withColumn("h", h).join(F.broadcast(shares), "lang").where(F.pmod(F.col("h"), F.lit(1 << 32)) < F.col("share") * float(1 << 32))
    some = some.dropDuplicates(["lang", "doc_id", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 32)), "h", "doc_id"))
    return some.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of the rows (doc_id, text, lang) with a lang: frequencies over all rows, weights from at
    most ``sample`` of them, or one for each language where there are more of these. Each language has an equal share, and a smaller one all that it has:
    every language of the table is learned. The driver gets the features of these rows, whose number FEATURES bounds for each, and a count by language."""
    known = docs.where("lang is not null and text is not null")
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = _sampled(known.select("doc_id", "lang", "text"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                at, counts, _ = grams.numbers([t.decode() for t in texts])
                ends = np.cumsum(counts)
                ids, tf = [], []
                for a, b in zip(ends - counts, ends, strict=True):
                    i, n = np.unique(grams.of(at[a:b]), return_counts=True)
                    ids.append(i)
                    tf.append(n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "lang", "ids", "tf"])

    got = rows.mapInArrow(run, "doc_id long, lang string, ids array<int>, tf array<long>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (mix(np.array([got["doc_id"][i].as_py() or 0]).astype(np.uint64))[0], got["lang"][i].as_py()))
    languages = sorted({x for x in got["lang"].to_pylist()})
    examples, labels = [], []
    for i in order:
        ids, tf = (np.array(got[c][i].values) for c in ("ids", "tf"))
        if len(ids):
            examples.append((ids, tf / tf.sum() * idf[ids] * SCALE))
            labels.append(languages.index(got["lang"][i].as_py()))
    model = fit(examples, labels, languages)
    model.weights = (model.weights * (idf[model.rows] * SCALE)[:, None]).astype(np.float32)
    return model


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (its probability) for each whole text. Null texts, texts without a letter and all texts where no
    language was learned give ``und`` with score 0; every row stays; columns of these names are replaced. No shuffle; the
    model has at most FEATURES rows."""
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        weights, names = m.table(), [*m.languages, "und"]
        grams = Grams()
        sums = np.zeros((0, weights.shape[1] + 1), np.float32)  # of each word: its n-grams' weights, and their number
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                at, counts, fresh = grams.numbers([(t or b"").decode() for t in texts])
                done = 0 if fresh else len(sums)
                if done < grams.ids.n or fresh:
                    ids, n = grams.ids.gather(np.arange(done, grams.ids.n))
                    new = np.zeros((len(n), sums.shape[1]), np.float32)
                    some = np.flatnonzero(n)
                    if len(some):
                        new[some, :-1] = np.add.reduceat(weights[ids], (np.cumsum(n) - n)[some], axis=0)
                    new[:, -1] = n
                    sums = np.concatenate([sums[:done], new])
                total = np.zeros((len(texts), sums.shape[1]))
                some = np.flatnonzero(counts)
                if len(some):
                    total[some] = np.add.reduceat(sums[at], (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
                lettered = (total[:, -1] > 0) & (len(m.languages) > 0)
                if m.languages:
                    s = (total[:, :-1] / np.maximum(1, total[:, -1:]) + m.bias) / m.temperature
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                label = [names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(label), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def apart(doc_id):
    """Whether a document is kept from the learning."""
    return held_out(doc_id, 3, 1)
