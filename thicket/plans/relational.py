"""Relational operations that a corpus of tables needs beside its trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.storage import written


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with ``values`` of the latest row of right with the keys and right_time <= left_time.

    Both sides are one sorted run per key; the last value is carried down it by a window, so
    there is one shuffle and no pair of rows is ever formed.
    """
    l = left.withColumn("t_", F.col(left_time)).withColumn("side_", F.lit(1))  # noqa: E741
    packed = F.struct(*[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), packed.alias("v_"))
    both = l.unionByName(r, allowMissingColumns=True)
    run = Window.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("last_", F.last("v_", ignorenulls=True).over(run)).filter("side_ = 1")
    return out.select(*left.columns, *[F.col(f"last_.{v}").alias(v) for v in values])


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark keeps k per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def descendants(edges: DataFrame, roots: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(root, node) of everything reachable from roots(node) over edges(parent, child), by rounds of joins.

    Each round's new rows are a written table, so plans don't grow with the rounds.
    """
    seen = roots.select(F.col("node").alias("root"), "node")
    fresh = seen
    for _ in range(max_rounds):
        step = fresh.join(edges, fresh["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        fresh = written(step.join(seen, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError("descendants: too many rounds")
