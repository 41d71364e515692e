"""Contigs from placed reads, and reads as differences from them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.order import running_sum

#: For each base of the contig, the bases of a read that codes 0, 1, 2, 3 stand for.
NOISE = {"A": "CGTN", "C": "AGTN", "G": "TACN", "T": "GCAN", "N": "ACGT"}


def _code_map() -> Column:
    return F.create_map(*[F.lit(x) for ref, read in NOISE.items() for i, b in enumerate(read) for x in (ref + b, str(i))])


def _base_map() -> Column:
    return F.create_map(*[F.lit(x) for ref, read in NOISE.items() for i, b in enumerate(read) for x in (ref + str(i), b)])


def votes(placed: DataFrame) -> DataFrame:
    """contig_id, place, base, n for reads (contig_id, pos, seq): how many reads have a base at a place; N doesn't vote."""
    each = placed.select("contig_id", "pos", F.posexplode(F.split("seq", "")).alias("i", "base")).where(F.col("base").isin(*"ACGT"))
    return each.groupBy("contig_id", (F.col("pos") + F.col("i")).alias("place"), "base").agg(F.count("*").alias("n"))


#: Places of a box of a contig.
BOX = 64
_BASES = "ACGT"


def _box_votes(placed: DataFrame) -> DataFrame:
    """contig_id, box, votes: how many reads have each base at each place of a box, as whole numbers of 1 to 8 bytes. Reads are dealt out by ranges, so that a contig with many of them spreads over
    tasks; those of a batch are counted before anything else is shuffled."""
    dealt = placed.select("contig_id", F.col("pos").cast("long").alias("pos"), "seq").where("seq is not null and pos is not null")
    dealt = dealt.repartitionByRange("contig_id", "pos").sortWithinPartitions("contig_id", "pos")
    code = np.full(128, -1, np.int64)
    for i, x in enumerate(_BASES):
        code[ord(x)] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(2).to_pylist()
            upto = np.cumsum([0, *map(len, texts)])
            i = 0
            while i < len(texts):  # long reads in smaller parts
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + (1 << 21), "right")) - 1)
                batch, own = whole.slice(i, j - i), "".join(texts[i:j])
                sizes, i = np.diff(upto[i : j + 1]), j
                letters = np.frombuffer(own.encode("utf-32-le"), np.uint32)
                base = np.where(letters < 128, code[np.minimum(letters, 127)], -1)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = batch.column(1).to_numpy()[row] + np.arange(len(letters)) - (np.cumsum(sizes) - sizes)[row]
                row, place, base = row[base >= 0], place[base >= 0], base[base >= 0]
                if not len(row):
                    continue
                names = batch.column(0).dictionary_encode()
                numbers = names.indices.fill_null(len(names.dictionary)).to_numpy()[row]
                box = place // BOX
                low, span = int(box.min()), int(box.max() - box.min()) + 1
                pairs, group = np.unique(numbers.astype(np.int64) * span + (box - low), return_inverse=True)
                votes = np.bincount(group * (4 * BOX) + place % BOX * 4 + base, minlength=len(pairs) * 4 * BOX).reshape(-1, 4 * BOX)
                width = next(w for w in (1, 2, 4, 8) if votes.max() < 1 << (8 * w - 1))
                ids = pa.array([*names.dictionary.to_pylist(), None], names.dictionary.type).take(pa.array(pairs // span))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pairs % span + low), pa.array([v.tobytes() for v in votes.astype(f"<i{width}")], pa.binary())], names=["contig_id", "box", "votes"])

    return dealt.mapInArrow(run, T.StructType([placed.schema["contig_id"], T.StructField("box", T.LongType()), T.StructField("votes", T.BinaryType())]))


def _called(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, np.ndarray]]:
    """(contig, box, letters) of each box in order, for rows of ``_box_votes`` in order of contig and box: the base with the most votes, of equal ones the first in the alphabet, N where there is none."""
    letters = np.frombuffer(f"{_BASES}N".encode(), np.uint8)

    def call(votes: np.ndarray) -> np.ndarray:
        v = votes.reshape(BOX, 4)
        return letters[np.where(v.sum(1) > 0, v.argmax(1), 4)]

    key, held = None, None
    for batch in batches:
        for contig, box, votes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.frombuffer(votes, f"<i{len(votes) // (4 * BOX)}").astype(np.int64)
            if held is not None and key == (contig, box):
                held = held + own
                continue
            if held is not None:
                yield *key, call(held)
            key, held = (contig, box), own
    if held is not None:
        yield *key, call(held)


def _boxes(placed: DataFrame) -> DataFrame:
    """The boxes' votes, all those of a contig in one task, in order: as many rows as the contig has boxes and its reads have batches."""
    return _box_votes(placed).repartition("contig_id").sortWithinPartitions("contig_id", "box")


def consensus(placed: DataFrame) -> DataFrame:
    """contig_id, place, base: the base with the most votes, of equal ones the first in the alphabet."""
    own = T.StructType([placed.schema["contig_id"], T.StructField("place", T.LongType()), T.StructField("base", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, bases, n = [], [], [], 0
        first = next(batches, None)
        if first is None:
            return
        own_type = first.schema.field(0).type

        def made() -> pa.RecordBatch:
            counts = [len(x) for x in places]
            index = np.repeat(np.arange(len(ids)), counts)
            text = np.concatenate(bases).tobytes().decode()
            return pa.RecordBatch.from_arrays([pa.array(ids, own_type).take(pa.array(index)), pa.array(np.concatenate(places)), pa.array(list(text), pa.string())], names=["contig_id", "place", "base"])

        for contig, box, text in _called(chain([first], batches)):
            at = np.flatnonzero(text != ord("N"))
            ids.append(contig), places.append(box * BOX + at), bases.append(text[at])
            n += len(at)
            if n > 50_000:
                yield made()
                ids, places, bases, n = [], [], [], 0
        if ids:
            yield made()

    return _boxes(placed).mapInArrow(run, own)


def contigs(placed: DataFrame) -> DataFrame:
    """contig_id, first (its first place), seq; places without a vote are N. Places are put together by boxes of ``BOX`` places, and these in order, so that the
    work grows with a contig's length; a contig is one row in the end: ``cut`` cuts longer ones beforehand."""
    own = T.StructType([placed.schema["contig_id"], T.StructField("first", T.LongType()), T.StructField("seq", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = next(batches, None)
        if begun is None:
            return
        own_type = begun.schema.field(0).type
        ids, firsts, texts, size = [], [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(ids, own_type), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["contig_id", "first", "seq"])
        for contig, group in groupby(_called(chain([begun], batches)), key=lambda x: x[0]):
            parts, before = [], None
            for _, box, text in group:
                parts += [b"N" * (BOX * (box - before - 1)) if before is not None else b"", text.tobytes()]
                start, before = (box if before is None else start), box
            joined = b"".join(parts).decode()
            bare = joined.lstrip("N")
            ids.append(contig), firsts.append(start * BOX + len(joined) - len(bare)), texts.append(bare.rstrip("N"))
            size += len(bare)
            if size > 1 << 20:
                yield made()
                ids, firsts, texts, size = [], [], [], 0
        if ids:
            yield made()

    return _boxes(placed).mapInArrow(run, own)


#: A contig ends where it has so many places or reads (fixed values).
MOST_PLACES, MOST_READS = 64 << 20, 10_000_000


def cut(placed: DataFrame, most_places: int = MOST_PLACES, most_reads: int = MOST_READS) -> DataFrame:
    """Adds piece, struct<by_place, by_reads>: the parts that a contig is cut into, by place of a read, and by the number of reads in the boxes before its own. Boxes are counted
    before a window sums them up, so that a contig's reads never meet in one task; pieces have up to one box's reads more than ``most_reads``."""
    box = F.floor(F.col("pos") / BOX)
    counts = placed.groupBy("contig_id", box.alias("__box")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("contig_id").orderBy("__box").rowsBetween(Window.unboundedPreceding, -1)
    part = counts.select("contig_id", "__box", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / most_reads).alias("__reads"))
    rows = placed.withColumn("__box", box).join(part.hint("merge"), ["contig_id", "__box"])
    return rows.withColumn("piece", F.struct(F.floor(F.col("pos") / most_places).alias("by_place"), F.col("__reads").alias("by_reads"))).drop("__box", "__reads")


def by_place(placed: DataFrame, key: str = "ordinal") -> DataFrame:
    """Reads in order of their contig and place, equal ones in order of ``key``; each partition before the next one."""
    return placed.repartitionByRange("contig_id", "pos", key).sortWithinPartitions("contig_id", "pos", key)


def offsets(contigs: DataFrame) -> DataFrame:
    """contig_id, length, start: where each contig starts when they are laid end to end in order of contig_id."""
    lengths = contigs.select("contig_id", F.length("seq").cast("long").alias("length"))
    return running_sum(lengths, [F.col("contig_id")], "length", "start")


def noise(ref: Column, seq: Column) -> Column:
    """array<struct<off, code>>: the places where a read differs from its part of the contig, in order."""
    codes = _code_map()
    pairs = F.zip_with(F.split(ref, ""), F.split(seq, ""), lambda a, b: F.when(a != b, F.element_at(codes, F.concat(a, b))))
    marked = F.transform(pairs, lambda c, i: F.struct(i.alias("off"), c.alias("code")))
    return F.filter(marked, lambda x: x["code"].isNotNull())


def apply_noise(ref: Column, noise: Column) -> Column:
    """The read that ``noise`` makes of its part of the contig; a place beyond the read fails."""
    bases = _base_map()

    def step(s: Column, x: Column) -> Column:
        at = x["off"] + 1
        bad = (at < 1) | (at > F.length(ref))
        changed = F.concat(F.substring(s, F.lit(1), x["off"]), F.element_at(bases, F.concat(F.substring(ref, at, F.lit(1)), x["code"])), F.substring(s, at + 1, F.length(s)))
        return F.when(bad, F.raise_error(F.lit("noise beyond the read")).cast("string")).otherwise(changed)

    return F.aggregate(noise, ref, step)


def fetch(spans: DataFrame, contigs: DataFrame, width: int = BOX) -> DataFrame:
    """For spans (ordinal, start, len) over contigs (start, seq) laid end to end: ordinal and the bases. Contigs are cut into pieces of ``width`` bases before
    the shuffle, both are dealt into boxes of as many places, so that the range join is one on equal boxes; a span may pass over contigs."""
    boxed = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    s = spans.select("ordinal", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e")).withColumn("box", boxed(F.col("s"), F.col("e")))
    pieces = contigs.select("start", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})"), F.lit(1))).alias("i", "piece"))
    c = pieces.select((F.col("start") + F.col("i") * width).alias("cs"), "piece").withColumn("ce", F.col("cs") + F.length("piece")).withColumn("box", boxed(F.col("cs"), F.col("ce")))
    meet = (F.col("cs") < F.col("e")) & (F.col("s") < F.col("ce"))
    at = F.greatest("s", "cs")
    first = F.floor(at / width) == F.col("box")  # each meeting once
    bases = F.substring("piece", (at - F.col("cs") + 1).cast("int"), (F.least("e", "ce") - at).cast("int"))
    parts = s.join(c, "box").where(meet & first).select("ordinal", F.struct(at.alias("at"), bases.alias("bases")).alias("p"))
    return parts.groupBy("ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["bases"]), "").alias("bases"))
