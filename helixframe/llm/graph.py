"""Connected components: tasks join what they hold, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.scratch import materialize, tables

#: Edges that a task holds at once, about.
HELD = 1_000_000


def _forest(edges: DataFrame) -> DataFrame:
    """u, v: each node of a partition's edges with the smallest node that these connect it to. A task holds HELD edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, int] = {}

        def find(x: int) -> int:
            while of.setdefault(x, x) != x:
                of[x] = x = of[of[x]]
            return x

        def found() -> pa.RecordBatch:
            inner = [x for x in of if of[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(inner, pa.int64()), pa.array([find(x) for x in inner], pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = find(u), find(v)
                of[max(a, b)] = min(a, b)
            if len(of) > 2 * HELD:
                yield found()
                of.clear()
        yield found()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, held: int = HELD, keep=materialize) -> DataFrame:
    """For edges (a, b) of longs: node and root, the smallest node of its component, for every node of an edge between two nodes.

    Edges are dealt out evenly, about ``held`` to a task, and each task joins its own, which leaves an edge for each node that isn't the smallest
    of its tree. When one task has had all of them, these are the components; else a turn connects a node's larger
    neighbours to its smallest one, then its smaller ones, and what is left is dealt out again. Turns end when nothing changes, after a number
    of them that grows with the logarithm of the nodes. Every turn is written to the shared folder, and what it was made of goes. Minima are written
    before they are joined, so that adaptive execution splits nodes with many edges. ``keep`` writes the result."""
    with tables(edges.sparkSession, "graph") as own:
        return keep(_components(edges, held, own), "roots")


def _components(edges: DataFrame, held: int, keep) -> DataFrame:
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        tasks = max(1, -(-mark[0] // held))
        now = keep(_forest(now.repartition(tasks)), "forest")
        if tasks > 1:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
            large = both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = keep(large, "large")
            least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least.hint("merge"), "u")
            small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
            now = keep(small, "edges")
        new = _mark(now)
        if tasks == 1 or new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))).first())
