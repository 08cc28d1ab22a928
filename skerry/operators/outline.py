"""Outlines of sets of grid cells: closed rings of cell edges, found by doubling pointers.

An edge runs along a set cell whose neighbour is not set, with the cell on its right hand (rows count downwards), so outer
rings run clockwise and holes the other way. Its successor starts where it ends; where two cells touch at a corner only,
the ring stays with its own cell. Every round joins each edge with the one that its pointer names and doubles the reach
of the pointers, so a ring of n edges takes log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.tables import written

#: From the cell (row, col): neighbour beyond the edge, the edge's two ends, and its direction (east, south, west, north).
_SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]


def boundary_edges(cells: DataFrame) -> DataFrame:
    """y1, x1, y2, x2 (corners) and dir of each edge between a set cell (row, col) and one that is not set."""
    sides = F.array(*[F.struct(F.lit(n[0]).alias("dr"), F.lit(n[1]).alias("dc"), F.lit(a[0]).alias("y1"), F.lit(a[1]).alias("x1"), F.lit(b[0]).alias("y2"), F.lit(b[1]).alias("x2"), F.lit(i).alias("dir")) for i, (n, a, b) in enumerate(_SIDES)])
    each = cells.distinct().withColumn("s", F.explode(sides))
    each = each.select((F.col("row") + F.col("s.dr")).alias("nr"), (F.col("col") + F.col("s.dc")).alias("nc"), *[(F.col("row") + F.col(f"s.{y}")).alias(y) for y in ("y1", "y2")], *[(F.col("col") + F.col(f"s.{x}")).alias(x) for x in ("x1", "x2")], F.col("s.dir").alias("dir"))
    there = cells.distinct().select(F.col("row").alias("nr"), F.col("col").alias("nc"))
    return each.join(there, ["nr", "nc"], "left_anti").select("y1", "x1", "y2", "x2", "dir")


def rings(cells: DataFrame) -> DataFrame:
    """ring (a number), pos (from 0, along the ring), y1, x1, y2, x2 of every boundary edge.

    A ring is named by its first edge in the order of y1, x1 and dir.
    """
    name = F.struct("y1", "x1", "dir")
    edges = written(boundary_edges(cells).withColumn("e", name), "edges")
    # of the edges that start where this one ends: a right turn, straight on, a left turn
    after = edges.select(F.col("y1").alias("y2"), F.col("x1").alias("x2"), F.col("dir").alias("_d"), F.col("e").alias("next"))
    turn = F.pmod(F.col("dir") + 1 - F.col("_d"), F.lit(4))
    linked = edges.join(after, ["y2", "x2"]).groupBy("e").agg(F.min_by("next", turn).alias("next"))
    now = written(linked.select("e", "next", F.least("e", "next").alias("first")), "linked")
    while True:  # the least edge of those that the pointer has passed
        ahead = now.select(F.col("e").alias("next"), F.col("next").alias("_n"), F.col("first").alias("_f"))
        then = written(now.join(ahead, "next").select("e", F.col("_n").alias("next"), F.least("first", "_f").alias("first"), (F.col("_f") < F.col("first")).alias("_less")), "linked")
        now = then.drop("_less")
        if then.where("_less").isEmpty():
            break
    first = now.select("e", "first")
    # steps left to the ring's first edge
    left = linked.join(first, "e").select("e", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), F.lit(0).cast("long").alias("steps"), "first")
    left = written(left.withColumn("steps", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")), "left")
    while not left.where("next IS NOT NULL").isEmpty():
        ahead = left.select(F.col("e").alias("next"), F.col("next").alias("_n"), F.col("steps").alias("_s"))
        left = written(left.join(ahead, "next", "left").select("e", F.col("_n").alias("next"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), "first"), "left")
    size = left.groupBy("first").agg(F.max("steps").alias("most"))
    placed = left.join(size, "first").select("e", "first", (F.col("most") - F.col("steps")).alias("pos"))
    out = edges.join(placed, "e")
    number = F.xxhash64("first")
    return out.select(number.alias("ring"), "pos", "y1", "x1", "y2", "x2", F.col("first.y1").alias("first_y"), F.col("first.x1").alias("first_x"))


def ring_figures(edges: DataFrame) -> DataFrame:
    """ring, first_y, first_x, n_edges and area in cells (negative for holes) of ``rings``."""
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return edges.groupBy("ring", "first_y", "first_x").agg(F.count("*").alias("n_edges"), area.cast("long").alias("area"))
