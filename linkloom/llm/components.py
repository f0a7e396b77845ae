"""Connected components by union-find over tables: alternating stars, narrow rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every left end has one right end, which is no left end itself."""
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.lit(n).alias("left")) for c, n in (("u", 1), ("v", 0))))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("left").alias("lefts"), F.min("left").alias("least"))
    # a left end that is met twice, or also as a right end
    return not nodes.agg(F.max(F.col("lefts") > F.col("least"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``a, b`` edges that is not its component's smallest node.

    Each round every node takes its larger neighbours to the smallest node it knows
    (large star), then its smaller ones (small star).  What a node knows is a
    minimum, reduced in each task, so a node with very many edges is no burden;
    each step is a written table.  No edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the least neighbour stays the node's own, which moves the others there
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        e = written(large.join(least, "u").select(moved.alias("u"), F.col("m").alias("v")).distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
