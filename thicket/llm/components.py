"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import written

#: Tasks over which the neighbours of one node are dealt at most.
SALTS = 16


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Edges are undirected; loops, repeats and nulls in either end are ignored.  Each step is
    an aggregation (map-side combined minimum) and a salted equi-join back, so the edges of a
    node of very many never meet in one task; each round ends in a written table.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    ends = written(ends)
    mark = _mark(ends)
    for _ in range(max_rounds):
        new = written(_small_star(_large_star(ends)))
        before, mark = mark, _mark(new)
        if mark == before:
            return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends.select("v", "v").distinct())
        ends = new
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def _mark(ends: DataFrame) -> tuple:
    """Tells two sets of edges apart: their number and two sums of 64-bit hashes."""
    h = F.xxhash64("u", "v")
    return tuple(ends.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_000_007)))).first())


def _large_star(ends: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (itself included)."""
    both = ends.union(ends.select("v", "u")).toDF("x", "y")
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    # A node of very many neighbours: they meet its minimum under one of SALTS salts.
    spread = least.select(F.col("x").alias("hub"), "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("hub_salt"))
    larger = both.filter("y > x").withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)))
    moved = larger.join(spread, (F.col("x") == F.col("hub")) & (F.col("salt") == F.col("hub_salt"))).select(F.col("y").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def _small_star(ends: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all go to the smallest of them."""
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
    moved = ends.join(least, F.col("u") == F.col("hub")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("hub", "m")).filter("u > v").distinct()
