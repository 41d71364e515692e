"""SimHash fingerprints and the search for near ones, in DataFrame operations alone.

A text's terms are its pairs of neighbouring words (the last word stands alone too), weighted by how often they stand
in it. Each term's 64-bit hash votes on every bit with its weight; a bit is set if more weight votes for it than
against. Two bits' votes are counted in the halves of one sum, so 32 sums hold all 64 votes.

The search rests on permuted tables: the 64 bits are cut into blocks, and a table for each choice of
(blocks - radius) blocks is keyed by their bits. Fingerprints within the radius differ in at most ``radius`` blocks,
so they meet in a table; the distance is then checked."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.scratch import materialize
from helixframe.scratch import tables as scratch_tables

BITS, RADIUS, BLOCKS = 64, 3, 6
_PAIR = 0x0000000100000001


def terms(text: Column) -> Column:
    """Hashes of the terms of a text: array<long>, one for each word."""
    words = F.array(F.split(text, r"[\x20\x09-\x0D]+"))
    # the outer function only binds the words, which would else be split anew for each of them
    return F.get(F.transform(words, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))), F.lit(0))


def votes(hashed: Column) -> list[Column]:
    """The 32 sums over the terms ``hashed``, and how many there are."""
    pair = F.lit(_PAIR).cast("long")
    return [*(F.sum(F.shiftright(hashed, i).bitwiseAND(pair)).alias(f"v{i}") for i in range(32)), F.count("*").alias("n")]


def decided() -> Column:
    """The fingerprint (long) from the sums of ``votes``."""
    low = "v & 4294967295"
    bits = f"a.fp | if(2 * ({low}) > n, shiftleft(1L, a.i), 0L) | if(2 * shiftrightunsigned(v, 32) > n, shiftleft(1L, 32 + a.i), 0L)"
    sums = ", ".join(f"v{i}" for i in range(32))
    return F.expr(f"aggregate(array({sums}), named_struct('fp', 0L, 'i', 0), (a, v) -> named_struct('fp', {bits}, 'i', a.i + 1), a -> a.fp)")


def text_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (BITS - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def fingerprints(df: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """The columns ``key`` and a long fp_<column> for each of the text columns; ``key`` must be unique. Where ``df`` is already dealt
    out by ``key``, nothing is shuffled; else a row for each key and column is."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(t).alias("text")) for i, t in enumerate(texts)])
    each = df.select(*key, F.explode(sides).alias("s")).select(*key, "s.side", F.explode(terms(F.col("s.text"))).alias("t"))
    one = each.groupBy(*key, "side").agg(*votes(F.col("t"))).select(*key, "side", decided().alias("fp"))
    return one.groupBy(*key).agg(*[F.max(F.when(F.col("side") == i, F.col("fp"))).alias(f"fp_{t}") for i, t in enumerate(texts)])


def tables(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each fingerprint and permuted table: table, bits (those of the table's blocks, the rest zero)."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = F.array(*[F.struct(F.lit(i).alias("table"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    return fps.select("*", F.explode(rows).alias("__t")).select(*fps.columns, "__t.table", "__t.bits")


def near(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (query, fp, distance) of a distinct fingerprint ``query`` of ``queries`` and a distinct ``fp`` of ``fps`` (both have a
    long column fp) that differ in at most ``radius`` bits; equal ones have distance 0. Nulls meet nothing."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("it takes 0 <= radius < blocks <= 64")
    q = tables(queries.select(F.col("fp").alias("query")).where("query is not null").distinct(), "query", radius, blocks)
    x = tables(fps.select("fp").where("fp is not null").distinct(), "fp", radius, blocks)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).cast("int")
    return q.join(x.hint("merge"), ["table", "bits"]).where(distance <= radius).select("query", "fp", distance.alias("distance")).distinct()


#: A document's key in plain columns that are never null: whether doc_id is, doc_id or 0, the text's hash.
KEY = ["nul", "a", "h"]


def _keyed(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("a"), F.xxhash64("text").alias("h"), "text")


def _chain(keys: DataFrame, keep) -> DataFrame:
    """For rows of KEY, n and copies: the key, n and copies of the next and the previous one in descending order of doc_id (nulls last, then by
    hash), the last meeting the first. Rows are sorted in ranges; only the ends of ranges meet in one task."""
    dealt = keys.repartitionByRange(F.col("nul"), F.col("a").desc(), F.col("h")).withColumn("part", F.spark_partition_id())
    dealt = keep(dealt, "order")
    row = F.struct(*KEY, "n", "copies")
    inside = Window.partitionBy("part").orderBy(F.col("nul"), F.col("a").desc(), F.col("h"))
    linked = keep(dealt.select("part", row.alias("own"), F.lead(row).over(inside).alias("next"), F.lag(row).over(inside).alias("prev")), "links")
    # one row for each range that has rows: as many as shuffle partitions
    ends = linked.groupBy("part").agg(F.first(F.when(F.col("prev").isNull(), F.col("own")), True).alias("first"), F.first(F.when(F.col("next").isNull(), F.col("own")), True).alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after, before = F.coalesce(F.lead("first").over(order), F.first("first").over(whole)), F.coalesce(F.lag("last").over(order), F.last("last").over(whole))
    both = linked.join(F.broadcast(ends.select("part", after.alias("after"), before.alias("before"))), "part")
    both = both.select("own", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))
    flat = [F.col(f"own.{c}").alias(c) for c in (*KEY, "n", "copies")] + [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("next", "prev") for c in (*KEY, "n")]
    return keep(both.select(*flat), "chain")


def edited(df: DataFrame, keep=materialize) -> DataFrame:
    """KEY, n_chars, copies, next_ KEY, text, edited: the last floor(n/3) code points of each text replaced by the first as many (or all) of the
    next document, in descending order of doc_id; after the last comes the first. Null texts are empty; a null doc_id
    comes last. Rows that repeat a doc_id are ordered by their texts' hashes; rows equal in both are one document here, with the number of its copies.
    Texts are shuffled once, and the third that is passed on again. ``keep`` writes what the result reads."""
    keyed = _keyed(df)
    chain = _chain(keyed.groupBy(*KEY, F.length("text").alias("n")).agg(F.count("*").alias("copies")), keep)
    own = keyed.join(chain.hint("merge"), KEY)
    own = own.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))).where("__r <= 1").drop("__r")
    tails = own.select(*[F.col(f"prev_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, cast(floor(prev_n / 3) as int))").alias("tail"))
    joined = own.join(tails.hint("merge"), KEY)
    kept = F.expr("substring(text, 1, n - cast(floor(n / 3) as int))")
    return joined.select(*KEY, F.col("n").cast("long").alias("n_chars"), "copies", *[f"next_{c}" for c in KEY], "text", F.concat(kept, "tail").alias("edited"))


def compared(df: DataFrame, every: int = 20) -> DataFrame:
    """The fingerprints of all documents, of their edited texts and of the next documents with their likeness; n_near, for
    documents whose doc_id is divisible by ``every``: how many other documents have a fingerprint within RADIUS. Every row stays, those that repeat
    (doc_id, text) too; an empty table gives an empty one; other columns are left out."""
    with scratch_tables(df.sparkSession, "simhash") as keep:
        return materialize(_compared(df, every, keep), "fingerprints")


def _compared(df: DataFrame, every: int, keep) -> DataFrame:
    both = edited(df, keep)
    fps = fingerprints(both, KEY, ["text", "edited"])
    rows = both.select(*KEY, "n_chars", "copies", *[f"next_{c}" for c in KEY], F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).join(fps.hint("merge"), KEY)
    rows = keep(rows, "rows")
    after = rows.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("fp_text").alias("fp_next"))
    out = rows.join(after.hint("merge"), [f"next_{c}" for c in KEY])
    asked = ~F.col("nul") & (F.col("a") % every == 0)
    # sums are written before their joins: both sides are plain shuffles then, in which adaptive execution splits hot fingerprints
    counts = keep(rows.groupBy(F.col("fp_text").alias("fp")).agg(F.sum("copies").alias("n")), "counts")
    found = near(rows.where(asked).select(F.col("fp_text").alias("fp")), counts).join(counts.hint("merge"), "fp")
    found = keep(found.groupBy(F.col("query").alias("fp_text")).agg((F.sum("n") - 1).alias("found")), "found")
    out = out.join(found.hint("merge"), "fp_text", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.when(~F.col("nul"), F.col("a")).alias("doc_id"), "n_chars", "edited_sha256", text_of(F.col("fp_text")).alias("fingerprint"), text_of(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"), F.when(asked, F.col("found")).alias("n_near"),
    )
