"""Joins of lanes and mates by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


#: Places of a block in which rows of following places are shuffled together, and the least rows of a piece of one, in the mean, that make it worth while.
BLOCK, LEAST = 1024, 64


def mates(r1: DataFrame, r2: DataFrame, on: str = "ordinal", columns: tuple[str, ...] = ("id", "seq", "qual")) -> DataFrame:
    """Fragments: the rows of both lanes with equal places, as <column>_1 and <column>_2. A place that one lane lacks fails. Rows that lie in order are shuffled in pieces of blocks, packed by Arrow with Zstandard;
    others one by one."""
    sides = [r.select(on, *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k, r in ((1, r1), (2, r2))]
    if all(d.schema[on].dataType == LongType() and _in_pieces(d.select(on)) for d in sides):
        return _met(*sides, on)
    a, b = (d.withColumn(f"__{k}", F.lit(True)) for k, d in enumerate(sides, 1))
    both = a.join(b, on, "full")
    whole = F.when(F.col("__1").isNull() | F.col("__2").isNull(), F.raise_error(F.concat(F.lit("a mate is missing at place "), F.col(on).cast("string")))).otherwise(F.lit(True))
    return both.where(whole.cast("boolean")).drop("__1", "__2")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Where rows of following places of a block begin and end."""
    places = batch.column(0).to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(places) != 1) | (places[1:] % BLOCK == 0)) + 1).tolist(), len(places)]
    return ((i, j) for i, j in zip(cuts, cuts[1:], strict=False) if i < j)


def _in_pieces(places: DataFrame) -> bool:
    """Whether rows lie in pieces that are long enough; only places are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.column(0).null_count > 0
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([None if none else sum(1 for _ in _pieces(batch))], pa.int64())], names=["rows", "pieces"])

    rows, pieces, none = places.mapInArrow(run, "rows long, pieces long").agg(F.sum("rows"), F.sum("pieces"), F.bool_or(F.col("pieces").isNull())).first()
    return bool(rows) and not none and rows >= LEAST * pieces


def _met(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """The rows of both with equal places, a block at a time."""

    def packed(d: DataFrame, side: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks, parts = [], []
                for i, j in _pieces(batch):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(batch.slice(i, j - i))
                    blocks.append(batch.column(0)[i].as_py() // BLOCK), parts.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([side] * len(blocks), pa.int32()), pa.array(parts, pa.binary())], names=["block", "side", "part"])

        return d.mapInArrow(run, "block long, side int, part binary")

    def joined(pieces: pa.Table) -> pa.Table:
        found = {1: [], 2: []}
        for side, part in zip(pieces["side"].to_pylist(), pieces["part"].to_pylist(), strict=True):
            found[side].append(pa.ipc.open_stream(part).read_all())
        one, two = (pa.concat_tables(x).sort_by(on) if x else None for x in found.values())
        for x, y in ((one, two), (two, one)):
            lacking = x is not None and (x[on] if y is None else x[on].filter(pc.invert(pc.is_in(x[on], value_set=y[on].combine_chunks()))))
            if x is not None and len(lacking):
                raise ValueError(f"a mate is missing at place {lacking[0].as_py()}")
        if one[on].equals(two[on]) and pc.count_distinct(one[on]).as_py() == len(one):
            return pa.table([*one.columns, *two.columns[1:]], names=[*one.column_names, *two.column_names[1:]])
        return one.join(two, on, join_type="inner")

    schema = StructType([*a.schema.fields, *b.schema.fields[1:]])
    return packed(a, 1).unionByName(packed(b, 2)).groupBy("block").applyInArrow(joined, schema)


def follow(order: DataFrame, n: int) -> DataFrame:
    """For the new places (old, new) of the first mates, those of both: the second mates of n fragments follow in the same order."""
    return order.unionByName(order.select((F.col("old") + n).alias("old"), (F.col("new") + n).alias("new")))


def bad_permutation(order: DataFrame, n: int) -> DataFrame:
    """New places that don't occur once, or don't lie in 0 .. n - 1; empty for a permutation."""
    return order.groupBy("new").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("new") < 0) | (F.col("new") >= n))


def mate_flag(aligned_1: Column, aligned_2: Column, delta: Column) -> Column:
    """0: both aligned, the second at most 32766 behind; 1: both, farther or before; 3, 4: one only; 2: none."""
    near = (delta >= 0) & (delta < 32767)
    return F.when(aligned_1 & aligned_2 & near, 0).when(aligned_1 & aligned_2, 1).when(aligned_1, 3).when(aligned_2, 4).otherwise(2)


def reordered(side: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of a side stream at their new places: ordinal is replaced by the order's ``new``."""
    return side.join(order.select(F.col("old").alias("ordinal"), "new"), "ordinal").drop("ordinal").withColumnRenamed("new", "ordinal")
