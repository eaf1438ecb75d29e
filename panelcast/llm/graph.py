"""Connected components of an edge list, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def _print(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is
    named by its least node.

    Alternating large and small stars (published MapReduce algorithm): each
    round points nodes at the least neighbour, in a few shuffles of the edges,
    and the rounds grow with the logarithm of the longest path. Every round is
    checkpointed in the shared folder. Edges with a null end are left out.
    """
    cur = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
           .where("a is not null and b is not null and u > v").distinct())
    cur = cut_lineage(cur)
    seen = _print(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join's sides are shuffled apart and the edges of one centre can be split
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        cur = cut_lineage(small)
        now = _print(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
