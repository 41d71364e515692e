"""Row numbers over a total order without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.scratch import materialize


#: A task's number and a row's place in the task, as ``monotonically_increasing_id`` has them (fixed value).
_PLACE_BITS = 33


def ranged(df: DataFrame, keys: list[Column], kept: list[str] | None = None, then: list[Column] = (), more: Callable[[DataFrame], DataFrame] | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """The rows (their columns ``kept``, all by default) dealt out by ranges of ``keys`` and sorted by these and ``then``, with __part, the range, and __row, the place in it. They are written once, so that
    the ranges stay the same; places are counted while they are written, so that no second shuffle brings a range together again. ``more`` works on the sorted ranges and keeps their order. ``dealt``: the rows, if they are dealt out already."""
    dealt = (dealt or df.repartitionByRange(*keys)).sortWithinPartitions(*keys, *then).select(*(kept or df.columns))
    dealt = (more(dealt) if more else dealt).withColumn("__id", F.monotonically_increasing_id())
    split = {"__part": F.shiftright("__id", _PLACE_BITS), "__row": F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}
    return materialize(dealt, "ranges").withColumns(split).drop("__id")


def with_ordinal(df: DataFrame, keys: list[Column], out: str = "ordinal", kept: list[str] | None = None) -> DataFrame:
    """Adds to the rows (their columns ``kept``, all by default) the 0-based place of each row in the order of ``keys``: rows are dealt out by ranges, numbered within each, and
    shifted by the rows of the ranges before."""
    dealt = ranged(df, keys, kept)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return dealt.join(F.broadcast(shift), "__part").withColumn(out, (F.col("__row") + F.col("__shift")).cast("long")).drop("__part", "__row", "__shift")


def running_sum(df: DataFrame, keys: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before in the order of ``keys``: by the same ranges as ``with_ordinal``."""
    dealt = ranged(df, keys)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    shift = sums.select("__part", F.coalesce(F.sum("__sum").over(before(Window.orderBy("__part"))), F.lit(0)).alias("__shift"))  # a row for each range
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("__part").orderBy("__row"))), F.lit(0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(shift), "__part").withColumn(out, (F.col("__inside") + F.col("__shift")).cast("long")).drop("__part", "__row", "__inside", "__shift")


#: Rows of a block of a stored column, and the least step that a stored delta can't have (fixed value).
DELTA_BLOCK, DELTA_ESCAPE = 10_000, 65_535


def position_deltas(df: DataFrame, value: str, key: str = "ordinal") -> DataFrame:
    """Positions as steps from the row before: delta, or ``DELTA_ESCAPE`` with the position in ``absolute`` where a block begins, the step is negative
    or too large. Blocks of ``DELTA_BLOCK`` places of ``key`` stand alone, so that tasks code them apart."""
    block = F.floor(F.col(key) / DELTA_BLOCK)
    step = F.col(value) - F.lag(value).over(Window.partitionBy("__block").orderBy(key))
    rows = df.withColumn("__block", block).withColumn("__step", step)
    step, fits = F.col("__step"), F.col("__step").between(0, DELTA_ESCAPE - 1)
    return rows.withColumns({"delta": F.when(fits, step).otherwise(DELTA_ESCAPE).cast("int"), "absolute": F.when(~F.coalesce(fits, F.lit(False)), F.col(value))}).drop(value, "__block", "__step")


def positions(coded: DataFrame, out: str, key: str = "ordinal") -> DataFrame:
    """The inverse of ``position_deltas``: steps are summed up from the last absolute position of the block on."""
    order = Window.partitionBy("__block").orderBy(key)
    rows = coded.withColumn("__block", F.floor(F.col(key) / DELTA_BLOCK)).withColumn("__run", F.count("absolute").over(order))
    inside = Window.partitionBy("__block", "__run").orderBy(key)
    return rows.withColumn(out, F.sum(F.coalesce(F.col("absolute"), F.col("delta").cast("long"))).over(inside)).drop("delta", "absolute", "__block", "__run")


def restore_order(df: DataFrame, key: str = "ordinal") -> DataFrame:
    """Rows in ascending order of ``key``, each partition before the next one."""
    return df.repartitionByRange(key).sortWithinPartitions(key)
