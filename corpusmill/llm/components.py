"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that are not their component's least; edges: (a, b), any direction.

    Alternates large-star (a node's larger neighbours go to its least neighbour) and small-star (its smaller ones do),
    until each component is a star around its least node. Minima are summed before the shuffle and joined back, so
    a node with very many edges is never gathered in one place. Each round is cut to the shared checkpoint folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # A star forest: no child is a parent, and each has one parent.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
