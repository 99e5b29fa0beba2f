"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import forget, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (hi, lo), hi > lo. Large: a node's larger neighbours point to its least neighbour; small: its smaller ones do, and itself."""
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    both = down if small else down.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        moved = both.join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of each node that an edge touches; component is its least node.

    Self-loops, repeated edges and nulls are ignored; no edges: no rows. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round. Hubs are joined by keys that AQE can split.
    """
    ends = edges.filter(F.col(a) != F.col(b))
    now = stored(ends.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        then = stored(_star(_star(now, False), True), "edges")
        forget(now)
        now, (last, before) = then, (before, mark(then))
        if last == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
