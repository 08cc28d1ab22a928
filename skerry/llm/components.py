"""Connected components of an edge table by alternating large and small stars, with each round written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """u, v: every node that is not the least of its component, with the least. ``edges``: u, v (no u = v), in any order.

    Each round is two grouped minima and two joins; a node with many edges is a skewed join key, which adaptive
    execution splits, and is combined before it is shuffled for the minima. Rounds end when one changes no edge.
    """
    now = written(edges.select("u", "v"), "edges")
    while True:
        large = written(_large_star(now), "large")
        then = written(_small_star(large), "small")
        same = then.count() == now.count() and then.join(now, ["u", "v"], "left_anti").isEmpty()
        forget(now, large)
        now = then
        if same:
            return now
