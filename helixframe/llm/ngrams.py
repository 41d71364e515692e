"""Similarity join of documents on the Jaccard similarity of their word n-grams, by token-combination prefixes.

A document's set is its distinct shingles of words. Tokens (shingles) of frequent ones form a class of their own, ordered
behind all others. Sets that are similar enough share much of their prefixes in this order, so that each set is indexed
by the rare tokens of its prefix, one by one, and where these are too few, the prefix is extended by frequent tokens, which
are dealt into groups and indexed by their pairs within a group: two sets that share two tokens of a group meet there.
For similarity T and a set of n tokens, n - ceil(T n) tokens at most are not in a similar set. A prefix is long enough when its
rare tokens, and its frequent ones but for one of each group, outnumber these.

Sets that meet are compared in two rounds: first with the most central set that they meet, then all that meet and don't yet
hang together. Bounds on the overlap (from sizes, from rare tokens that aren't shared, and from bitmaps of token parities)
drop pairs that can't be similar within the joins; all others are verified on their texts. Rows are sets, not
documents: equal sets are one row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.graph import components
from helixframe.llm.substrings import Bloom, bloom
from helixframe.llm.text import fresh, grams, hash_words, mix, slices, tidy
from helixframe.scratch import materialize, tables

SHINGLE, PERCENT = 4, 85
#: A token is frequent if it's in FREQUENT sets, counted where a block of BLOCK_TOKENS tokens has it in LOCAL sets; at most MOST of them, the commonest.
FREQUENT, LOCAL, BLOCK_TOKENS, MOST = 32, 4, 2_000_000, 1 << 18
#: Least bits of a bitmap; larger sets have as many as tokens, up to the next power of two.
LEAST_BITS = 512
_SALT = np.uint64(0xD6E8FEB86659FD93)


def token_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Token sets of texts: sorted 64-bit hashes of the distinct shingles; of the whole sequence where there are fewer words."""
    words = hash_words([(t or b"").lower() for t in texts])
    every = grams(words.hashes, shingle)
    out = []
    bounds = words.bounds.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        n = b - a
        if n >= shingle:
            own = np.sort(every[a : b - shingle + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            own = words.hashes[a:b]
            out.append(mix(grams(own, n) + np.uint64(int(_SALT) * n % 2**64)) if n else own)
    return out


def name(tokens: np.ndarray) -> int:
    """The number (64-bit hash) that a set goes by."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def parities(tokens: np.ndarray) -> bytes:
    """A bitmap of the parity of the tokens at each of its bits. The halves of a bitmap, one on the other, are the next smaller one."""
    size = max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    bits = np.bincount(((tokens >> np.uint64(17)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits that differ, at the smaller bitmap's size: no more than tokens that are in one of the sets only."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def least_overlap(total: int, percent: int = PERCENT) -> int:
    """The least overlap of two similar sets of ``total`` tokens together."""
    return -(-percent * total // (100 + percent))


def slack(n: int, percent: int = PERCENT) -> int:
    """How many tokens of a set of n may not be in a similar one."""
    return n - -(-percent * n // 100)


@cache
def groups_for(n: int, percent: int = PERCENT) -> int:
    """Into how many groups the frequent tokens of sets of n tokens, and of smaller ones similar to these, are dealt: a power of two, so that each has
    a few in a prefix, and so few that each of these sets, all frequent, has enough tokens besides one of each group (for a percentage above 50)."""
    groups = 1 << max(2, (max(1, slack(n, percent)) // 6).bit_length() - 1)
    sizes = range(max(1, -(-percent * n // 100)), n + 1)
    while groups > 1 and any(m - min(m, groups) <= slack(m, percent) for m in sizes):
        groups //= 2
    return groups


def signatures(tokens: np.ndarray, frequent_rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, np.ndarray]:
    """``frequent_rank``: for each token, -1 or its place among the frequent ones (commonest last). Returns the single-token
    signatures, the number of frequent tokens, and the pair signatures (empty if the prefix needs no frequent token)."""
    n = len(tokens)
    often = frequent_rank >= 0
    rare = tokens[~often]
    need = slack(n, percent) + 1
    none = np.zeros(0, np.uint64)
    if len(rare) >= need:
        return rare[:need], n - len(rare), none
    order = np.argsort(frequent_rank[often], kind="stable")
    common = tokens[often][order]
    out = []
    # a partner may be larger by so much that it deals its tokens into twice the groups
    for g in sorted({groups_for(n, percent), groups_for(100 * n // percent, percent)}):
        of = (common >> np.uint64(40)) & np.uint64(g - 1)
        again = np.ones(len(common), bool)
        again[np.unique(of, return_index=True)[1]] = False
        enough = np.flatnonzero(np.cumsum(again) >= need - len(rare))
        prefix, of = (common[: enough[0] + 1], of[: enough[0] + 1]) if len(enough) else (common, of)
        for one in np.unique(of):
            own = np.sort(prefix[of == one])
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(own[i] * _SALT + mix(own[j]) + np.uint64(g)))
    return rare, n - len(rare), np.concatenate(out) if out else none


_SET = "doc_id long, h long, n long, node long, bits binary, token long, count long"


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """A row for each document (doc_id, h, n, node and its bitmap), and rows (token, count) for tokens that are common within a block."""
    names = ["doc_id", "h", "n", "node", "bits", "token", "count"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def common() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= LOCAL
            return pa.RecordBatch.from_arrays([*[pa.nulls(int(some.sum()), pa.int64())] * 4, pa.nulls(int(some.sum()), pa.binary()), pa.array(token[some].view(np.int64)), pa.array(count[some].astype(np.int64))], names=names)

        for batch in batches:
            for part, texts in slices(batch, "text"):
                nodes, ns, bits = [], [], []
                for tokens in token_sets(texts, shingle):
                    ns.append(len(tokens))
                    nodes.append(name(tokens) if len(tokens) else None)
                    bits.append(parities(tokens))
                    if len(tokens) and nodes[-1] not in seen:
                        seen.add(nodes[-1])
                        held.append(tokens)
                        size += len(tokens)
                    if size >= BLOCK_TOKENS:
                        yield common()
                        held, seen, size = [], set(), 0
                null = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "h"]).columns, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), null, null], names=names)
        if held:
            yield common()

    return rows.select("doc_id", "h", "text").mapInArrow(run, _SET)


def _signed(rows: DataFrame, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """sig, node, n, hv (the tokens of the set that a meeting at this signature may share), c (share of frequent tokens, in thousandths)."""
    order = np.argsort(frequent)
    known = rows.sparkSession.sparkContext.broadcast((frequent[order], order))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = known.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                own = []
                for tokens in token_sets(texts, shingle):
                    if slack(100 * len(tokens) // percent, percent) == 0:
                        continue  # only an equal set is similar
                    node = name(tokens)
                    if node not in seen:
                        seen.add(node)
                        own.append((node, tokens))
                if len(seen) > 200_000:
                    seen.clear()
                if not own:
                    continue
                flat = np.concatenate([t for _, t in own])
                at = np.minimum(np.searchsorted(often, flat), max(0, len(often) - 1))
                ranks = np.where(often[at] == flat, rank[at], -1) if len(often) else np.full(len(flat), -1)
                sig, rows_of = [], []
                start = 0
                for node, tokens in own:
                    n = len(tokens)
                    one, common, two = signatures(tokens, ranks[start : start + n], percent)
                    start += n
                    sig += [one, two]
                    rows_of += [(len(one), node, n, n, 1000 * common // n), (len(two), node, n, common, 1000 * common // n)]
                r = np.array(rows_of, np.int64)
                each = np.repeat(r[:, 1:], r[:, 0], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), *(pa.array(each[:, i].astype(k)) for i, k in enumerate((np.int64, np.int32, np.int32, np.int32)))], names=["sig", "node", "n", "hv", "c"])

    return rows.select("text").mapInArrow(run, "sig long, node long, n int, hv int, c int")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether two sets that meet may share enough, by their sizes and by what they can share."""
    need = percent * (F.col(f"{x}n") + F.col(f"{y}n"))
    return (100 + percent) * F.least(F.col(f"{x}hv"), F.col(f"{y}hv")) >= need


def _near_bits(percent: int):
    """Whether two bitmaps differ in no more bits than similar sets of their sizes may differ in tokens."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, xn: pd.Series, yn: pd.Series) -> pd.Series:
        return pd.Series([differing(a, b) <= n + m - 2 * least_overlap(n + m, percent) for a, b, n, m in zip(x, y, xn.tolist(), yn.tolist(), strict=True)], dtype=bool)

    return near("xbits", "ybits", "xn", "yn")


def passing(values: DataFrame):
    """A function of a long column: false only where it's none of the ``values`` (one column of longs), by a filter of bounded size."""
    made = bloom(values)
    known = values.sparkSession.sparkContext.broadcast((made.blocks, made.bits))

    @F.pandas_udf("boolean")
    def passes(x: pd.Series) -> pd.Series:
        return pd.Series(Bloom(*known.value).has(x.to_numpy(np.int64).view(np.uint64)))

    return passes


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, percent: int, keep) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar. One text of each set (``firsts``: node, id, h) is brought together; a filter of bounded
    size keeps most other texts from the shuffle."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    first = keep(firsts.join(wanted.hint("merge"), "node"), "texts")
    # a text has one set; rows that repeat it go by its own key, so that the joins by node are of plain shuffles, in which adaptive execution splits hot nodes
    texts = docs.select("id", "h", "text").where(passing(first.select("h"))("h")).join(first.hint("merge"), ["id", "h"]).dropDuplicates(["id", "h"]).select("node", "text")
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if y is None or b[i] != last:
                    last, y = b[i], token_sets([batch.column(3)[i].as_py().encode()], shingle)[0]
                x = token_sets([batch.column(2)[i].as_py().encode()], shingle)[0]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def join(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (the text's hash), n_shingles and component_id for each row of (doc_id, text): the smallest doc_id that links reach, where two
    documents link if ``percent`` or more of the union of their sets is shared.

    Words are split at ASCII white space, A-Z in lower case. Null and empty texts have empty sets, link with nothing and are their own
    component. Rows with equal sets link; rows that repeat a doc_id are documents of their own that share the number;
    a null doc_id is no number to reach, and null where a component has no other. An empty table gives an empty one."""
    return _labelled(df, shingle, percent).drop("label")


def _labelled(df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of ``join`` with the label of their component, which two components never share (null for empty sets)."""
    with tables(df.sparkSession, "ngrams") as keep:
        return materialize(_joined(df, shingle, percent, keep), "ngram-components")


def _joined(df: DataFrame, shingle: int, percent: int, keep) -> DataFrame:
    docs = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = keep(_sets(docs, shingle), "sets")
    sets = found.where("n is not null").withColumn("id", F.coalesce("doc_id", F.lit(0)))
    # at most MOST tokens come to the driver
    counted = found.where("token is not null").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = counted.orderBy(F.desc("n"), "token").limit(MOST).toPandas()
    ranked = frequent["token"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    signed = keep(_signed(docs, ranked, shingle, percent), "signatures")
    shared = keep(signed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sig"), "shared")
    meet = keep(signed.where(passing(shared)("sig")).join(shared.hint("merge"), "sig"), "meetings")
    # summed up by set once, in front of all joins by set: a set that many documents have is one row in these
    own = sets.where("node is not null").groupBy("node").agg(F.max("bits").alias("bits"), F.min(F.struct("id", "h")).alias("d"))
    bits = keep(own.select("node", "bits", "d.id", "d.h"), "bits")
    firsts = bits.select("node", "id", "h")

    def bitmapped(rows: DataFrame, node: str, to: str) -> DataFrame:
        return rows.join(bits.select(F.col("node").alias(node), F.col("bits").alias(f"{to}bits")).hint("merge"), node)

    # round 1: each set with the most central of those that it meets most
    hub = keep(meet.groupBy("sig").agg(F.max(F.struct("c", "node", "n", "hv")).alias("hub")), "hubs")
    pairs = meet.join(hub.hint("merge"), "sig").where("node <> hub.node").select(F.col("node").alias("a"), F.col("n").alias("xn"), F.col("hv").alias("xhv"), F.col("hub.node").alias("b"), F.col("hub.n").alias("yn"), F.col("hub.hv").alias("yhv"))
    pairs = pairs.where(_possible("x", "y", percent)).groupBy("a", "b").agg(F.count("*").alias("times"), F.first("xn").alias("xn"), F.first("yn").alias("yn"))
    pairs = bitmapped(bitmapped(pairs, "a", "x"), "b", "y").where(_near_bits(percent))
    tested = keep(pairs.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "pairs")
    links = keep(_verified(tested, docs, firsts, shingle, percent, keep), "links")
    roots = components(links, keep=keep)
    # round 2: all that meet and don't hang together yet
    labelled = keep(meet.join(roots.hint("merge"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")
    apart = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("c", "node", "label")).alias("hub")).where("lo < hi").select("sig", F.col("hub.label").alias("main"))
    apart = keep(apart, "apart")
    open_ = keep(labelled.join(apart.hint("merge"), "sig"), "open")
    columns = ["node", "n", "hv", "label", "main"]
    x = open_.where("label <> main").select("sig", *[F.col(c).alias(f"x{c}") for c in columns])
    y = open_.select("sig", *[F.col(c).alias(f"y{c}") for c in columns])
    on = (x["sig"] == y["sig"]) & (F.col("xlabel") != F.col("ylabel")) & ((F.col("ylabel") == F.col("ymain")) | (F.col("xnode") < F.col("ynode"))) & _possible("x", "y", percent)
    more = x.join(y.hint("merge"), on)
    swap = F.col("xnode") > F.col("ynode")
    more = more.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"), F.when(swap, F.col("yn")).otherwise(F.col("xn")).alias("xn"), F.when(swap, F.col("xn")).otherwise(F.col("yn")).alias("yn")).distinct()
    more = bitmapped(bitmapped(more, "a", "x"), "b", "y").where(_near_bits(percent)).select("a", "b")
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = keep(more.join(done.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(more, docs, firsts, shingle, percent, keep))
    roots = components(links, keep=keep)
    named = sets.join(roots.hint("merge"), "node", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("label"))
    # sums are written before their joins here and above: both sides are plain shuffles then, in which adaptive execution splits hot keys
    least = keep(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least.hint("merge"), "label", "left").select("doc_id", "h", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` of which each component of similar documents keeps one, that with the smallest doc_id (of rows that share it, the one
    with the least hash of its text). Rows with an empty set and rows with a null doc_id stay."""
    found = _labelled(df.select("doc_id", "text"), shingle, percent).where("n_shingles > 0 and doc_id is not null")
    d, th, free = fresh(df, "d", "h", "free")
    first = materialize(found.groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("m")).select(F.col("m.doc_id").alias(d), F.col("m.h").alias(th)), "ngram-kept")
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = df.withColumns({d: F.col("doc_id").cast("long"), th: h, free: empty | F.col("doc_id").isNull()})
    kept = rows.where(~F.col(free)).join(first.hint("merge"), [d, th]).dropDuplicates([d, th])
    return rows.where(F.col(free)).select(*[f"`{c}`" for c in df.columns]).unionByName(kept.select(*[f"`{c}`" for c in df.columns]))
