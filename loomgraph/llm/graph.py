"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the least node of its component.

    Large-star and small-star in turn; every step is a grouped minimum and a join, so a hub's edges are never gathered.
    Edges are pairs of any one ordered type. Converges in a number of rounds that grows with the logarithm of the size.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours of u hang on the least node about u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its lesser neighbours hang on the least of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, scratch.write(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return scratch.write(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
