"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); component: the least node reachable.

    Alternating large-star and small-star rounds: each round points the larger neighbours of a node,
    then its smaller ones, to the least neighbour. Rounds grow with the logarithm of the longest
    path. Neighbours are combined by minima and joins on the node, never gathered.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == now:
            break
        sums = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
