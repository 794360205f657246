"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, join_split, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long): label is the smallest node reachable.

    Each step takes a minimum per node (pre-aggregated before the shuffle) and joins it back, nodes with very
    many neighbours in several tasks. A table written after each step ends the
    lineage; the steps needed grow with the logarithm of the longest chain. Loops and repeated edges
    don't matter; without edges there are no nodes.
    """
    star = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, edges_left = None, star.count()
    while True:
        # Large star: every larger neighbour of u moves to the least node near u.
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        upward = both.where("v > u")  # the edges of star, turned round
        large = join_split(upward, "u", least, "k", total=edges_left).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours all move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small)
        discard(star)
        star = new
        state = star.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        edges_left = state["n"]
        if state == before:
            break
        before = state
    return star.select(F.col("u").alias("node"), F.col("v").alias("label")).union(star.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
