"""Connected components of a graph given by its edges, for graphs of any size and shape.

Alternating large-star and small-star steps: each links a node's neighbours to the smallest
node among them, until every node hangs on the smallest one of its component. A step takes
the smallest neighbour with a combined aggregate and joins it back to the edges; that table
is written first, so that the join has two plain shuffled sides and Spark can split a hub.
Every step is a written table, so lineage does not grow and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.session import stage_table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage_table(both.groupBy("u").agg(F.min("v").alias("m")), "large-star")
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node a to the smaller b."""
    least = stage_table(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    ends = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ends.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` that is not its component's smallest.

    Loops, repeated edges and either direction are allowed; edges with a null end are ignored.
    No edges give no rows. Nodes that are not in the result are their own root.
    """
    edges = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                          F.least("a", "b").alias("b")).distinct())
    edges = stage_table(edges, "edges")
    before = None
    while before != (mark := _mark(edges)):
        before = mark
        large = stage_table(_large(edges), "edges")
        edges = stage_table(_small(large), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
