"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) links; the component
    is its smallest node.

    Each turn points every node's larger neighbours to its smallest
    neighbour, then its smaller ones (large star, small star).  The smallest
    neighbour comes from a partial aggregate and is joined back, so a node
    with very many links needs no list and its join can be split.  Turns
    grow with the logarithm of the nodes; each is checkpointed.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where(F.col("a") != F.col("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("x"), "m")
                 .union(low.select(F.col("a").alias("x"), "m"))
                 .where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        edges = cut(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    tops = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(tops.select("node", F.col("node").alias("component"))))
