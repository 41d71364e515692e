"""Mixing of sources to target weights in fixed-length blocks of words.

The documents of a source, in a pseudorandom but fixed order, make one stream of words, cut into blocks of one length, whatever the source's size. The output has as many slots as the targets ask blocks for. Each
output shard draws how many of its slots each source gets: a multinomial draw by what the targets still ask for, no more of a
source than that, so that the shards together meet the targets exactly. The i-th slot of a source holds the block that a
keyed permutation of its block numbers gives for i; after all blocks have been used once, the next key starts the
next pass. Slots and blocks then meet in a join by (source, block number)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.text import fresh, mix, slices, word_count
from helixframe.scratch import materialize

#: Weights of the sources, ordered by code point (null last), repeating; a source is used that often at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block of the mix, at any size. ``block_for``: most words, and how many blocks a source has at least where they have more than ``BLOCK``.
BLOCK, MOST_BLOCK, BLOCKS_EACH = 32, 4096, 4096
#: Slots of an output shard; slots that a task makes at once; seed of the draws and permutations.
SHARD, STEP, SEED = 1 << 20, 1 << 16, 20240229


def block_for(size: int) -> int:
    """Words of a block of a source of ``size`` words that has some thousand blocks, for a caller who wants them (``plan(block=...)``); the mix itself has blocks of ``BLOCK`` words."""
    return min(MOST_BLOCK, max(BLOCK, 1 << max(0, (size // BLOCKS_EACH).bit_length() - 1)))


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that share sum(sizes) by weight, none above ``most`` times its size; what is above is shared again
    by weight among the others until none is."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at the places ``i``: a four-round Feistel network over the next even
    number of bits, walked on while a value is n or more."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        return (a << np.uint64(half)) | b

    x = once(np.asarray(i, np.uint64))
    while (high := np.flatnonzero(x >= np.uint64(n))).size:
        x[high] = once(x[high])
    return x.astype(np.int64)


@dataclass
class Plan:
    """What is known of each source: number in code-point order, name, words, blocks, target in words, slots, words of a block."""

    number: list[int]
    source: list[str | None]
    size: list[int]
    blocks: list[int]
    target: list[float]
    slots: list[int]
    block: list[int] = field(default_factory=list)

    def shards(self, per_shard: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
        """(shard, source number, first slot of the source, slots) where a shard has any."""
        left = np.array(self.slots, np.int64)
        used = np.zeros(len(left), np.int64)
        rng = np.random.default_rng(seed)
        shard = 0
        while (total := int(left.sum())) > 0:
            drawn = left.copy() if per_shard >= total else draw(rng, left, per_shard)
            for s in np.flatnonzero(drawn):
                yield shard, int(s), int(used[s]), int(drawn[s])
            used += drawn
            left -= drawn
            shard += 1


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multinomial draw of ``n`` by the shares of what is left, no more of a source than it has; what is drawn beyond that is drawn again
    from the others. sum(left) is ``n`` or more."""
    out = np.zeros(len(left), np.int64)
    while n:
        rest = left - out
        out += np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        n -= int(out.sum()) - (int(left.sum()) - int(rest.sum()))
    return out


def with_sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds size: the words of the text (long; null: 0), in place of a column of that name."""
    return df.withColumn("size", word_count(F.col(f"`{text}`").cast("string")))


def plan(sized: DataFrame, weights=WEIGHTS, most: float = MOST, block: int | None = None) -> Plan:
    """One row for each source comes to the driver: their number is that of the weights to be chosen. ``block``: words of a block of any
    source (default: ``BLOCK``)."""
    rows = sized.groupBy("source").agg(F.sum("size").cast("long").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r["size"] or 0) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    block_of = [block or BLOCK for _ in sizes]
    blocks = [-(-s // b) for s, b in zip(sizes, block_of, strict=True)]
    # the last block may be short: slots by the mean words of the source's blocks
    slots = [min(int(most * b), round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, sizes, strict=True)]
    return Plan(list(range(len(rows))), [r.source for r in rows], sizes, blocks, targets, slots, block_of)


def positions(sized: DataFrame, buckets: int) -> DataFrame:
    """Adds first: the words before the document in its source's stream. Documents are ordered by a hash bucket, then
    doc_id, size and the text's hash ``h``; no task sorts more than a bucket of a source, or the buckets' sums of one source."""
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.col("h")), F.lit(buckets))
    dealt = sized.withColumn("__bucket", key)
    sums = dealt.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("source", "__bucket").orderBy("doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before")
    joined = dealt.join(b, dealt["source"].eqNullSafe(b["__s"]) & (dealt["__bucket"] == b["__b"]), "left")
    return joined.withColumn("first", F.col("__before") + F.col("__in")).drop("__bucket", "__s", "__b", "__before", "__in")


def slots(spark, known: Plan, per_shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: shard, number (of the source), slot (of the source), block. The driver draws a row for each shard
    and source; tasks make the slots."""
    drawn = list(known.shards(per_shard, seed)) or [(0, 0, 0, 0)]
    names = [str(s) for s in known.source]
    keys = [xxhash.xxh3_64_intdigest(f"{s is None}:{n}", seed) >> 8 for s, n in zip(known.source, names, strict=True)]
    blocks = known.blocks
    runs = spark.createDataFrame(drawn, "shard long, number int, first long, n long").where("n > 0")
    # long runs of slots in pieces, so that they spread over tasks
    pieces = runs.withColumn("a", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(STEP).cast("long"))))
    pieces = pieces.select("shard", "number", F.col("a").alias("first"), F.least(F.lit(STEP).cast("long"), F.col("first") + F.col("n") - F.col("a")).alias("n"))
    total = sum(n // STEP + 1 for _, _, _, n in drawn)
    schema = "shard long, number int, slot long, block long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = blocks[r["number"]]
                slot = np.arange(r["first"], r["first"] + r["n"])
                block = np.empty(len(slot), np.int64)
                for turn in np.unique(slot // n):
                    own = slot // n == turn
                    block[own] = permute(slot[own] % n, n, keys[r["number"]] + int(turn))
                ones = np.ones(len(slot), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ones * r["shard"]), pa.array((ones * r["number"]).astype(np.int32)), pa.array(slot), pa.array(block)], names=["shard", "number", "slot", "block"])

    return pieces.repartition(max(1, min(total, 4096)), "number", "first").mapInArrow(run, schema)


def _number(known: Plan) -> Column:
    """The source's number from its name. None is no key of a map."""
    out = F.lit(None).cast("int")
    pairs = [x for s, n in zip(known.source, known.number, strict=True) if s is not None for x in (F.lit(s), F.lit(n))]
    if pairs:
        out = F.create_map(*pairs)[F.col("source")]
    return F.when(F.col("source").isNull(), F.lit(len(known.source) - 1)).otherwise(out)


def _of(known: Plan, values: list, number: Column) -> Column:
    """The value of the source ``number``; null beyond the sources."""
    return F.get(F.array(*[F.lit(v) for v in values or [None]]), number)


def pieces(sized: DataFrame, known: Plan) -> DataFrame:
    """A row for each document and block of its source that has words of it: number, block, words in it, from (the first
    of them in the document). Documents without words have none."""
    rows = sized.count()
    placed = positions(sized, max(16, int(rows**0.5))).where("size > 0").withColumn("number", _number(known))
    placed = placed.withColumn("block_words", _of(known, known.block, F.col("number")).cast("long"))
    in_block = lambda c: F.floor(c / F.col("block_words"))
    out = placed.withColumn("block", F.explode(F.sequence(in_block(F.col("first")), in_block(F.col("first") + F.col("size") - 1))))
    start = F.greatest(F.col("block") * F.col("block_words"), F.col("first"))
    stop = F.least((F.col("block") + 1) * F.col("block_words"), F.col("first") + F.col("size"))
    return out.withColumns({"from": start - F.col("first"), "words": stop - start}).drop("block_words")


def mix_documents(df: DataFrame, weights=WEIGHTS, most: float = MOST, block: int | None = None, per_shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, Plan]:
    """Returns (a row for each document piece with ``times``, how often the mix takes its block; the sized documents;
    the plan). ``df`` needs doc_id, source and text; its column uid, a number for each row, is made where there is none. Null
    texts have no words; a null source is a source of its own; rows that repeat a doc_id are documents of their own. An empty table
    gives empty results."""
    uid = F.col("uid") if "uid" in df.columns else F.monotonically_increasing_id().alias("uid")
    sized = materialize(with_sizes(df.select(uid, "doc_id", "source", "text")).withColumn("h", F.xxhash64("text")).drop("text"), "mix-sizes")
    known = plan(sized, weights, most, block)
    own = pieces(sized, known)
    times = slots(df.sparkSession, known, per_shard, seed).groupBy("number", "block").agg(F.count("*").alias("times"))
    return own.join(times.hint("merge"), ["number", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0))), sized, known


def totals(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; see ``mix_documents``."""
    own, sized, known = mix_documents(df.select("doc_id", "source", "text"))
    taken = own.groupBy("uid").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
    number = _number(known)
    joined = sized.join(taken.hint("merge"), "uid", "left")
    return joined.select("doc_id", "size", _of(known, known.size, number).cast("long").alias("source_size"), _of(known, known.target, number).cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(df: DataFrame) -> DataFrame:
    """The mix as rows of ``df``: a document comes once for each time that any of its blocks is taken, each time with the
    words of the blocks that are taken so often or more; a document whose blocks are all taken comes with its text
    unchanged. Needs doc_id, source, text; n_chars, where there is one, is made anew. Documents without words (null and empty texts) leave; rows
    that repeat each other are mixed each on its own; an empty table gives an empty one; columns of any other names pass through."""
    uid, spans = fresh(df, "uid", "spans")
    keyed = materialize(df.withColumn(uid, F.monotonically_increasing_id()), "mix-rows")
    own, _, _ = mix_documents(keyed.select(F.col(uid).alias("uid"), "doc_id", "source", "text"))
    taken = own.where("times > 0").groupBy("uid").agg(F.max("times").alias("most"), F.collect_list(F.struct("from", "words", "times")).alias("all"))
    turns = taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))))
    turns = turns.select(F.col("uid").alias(uid), F.sort_array(F.expr("transform(filter(all, s -> s.times >= turn), s -> struct(s.from, s.words))")).alias(spans))
    rows = keyed.join(turns.hint("merge"), uid)
    kept = df.columns
    schema = T.StructType([df.schema[c] if c not in ("text", "n_chars") else T.StructField(c, T.StringType() if c == "text" else df.schema[c].dataType) for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                out = []
                for t, at in zip(texts, part.column(len(kept)).to_pylist(), strict=True):
                    words = (t or b"").split()
                    own = [w for s in at for w in words[s["from"] : s["from"] + s["words"]]]
                    out.append((t if len(own) == len(words) else b" ".join(own)).decode())
                columns = [pa.array(out) if c == "text" else pa.array([len(x) for x in out], part.column(i).type) if c == "n_chars" else part.column(i) for i, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    return rows.select(*[F.col(f"`{c}`") for c in kept], spans).mapInArrow(run, schema)
