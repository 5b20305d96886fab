"""Connected components of an edge table, in rounds that grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.folders import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (u, v) of one ordered type: root is the least node of the component.

    Every node hangs on a lesser one. In a round its neighbours, then the lesser ones alone, move to the least of them, as grouped
    minima and joins, so a hub's neighbours are never gathered; what is cut loose by moving stays joined by the new links.
    """
    shared_folder(edges.sparkSession)
    links = edges.where("u != v").select(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).distinct().checkpoint()
    seen = None
    while True:
        ends = links.select(F.col("high").alias("x"), F.col("low").alias("y")).unionByName(links.select(F.col("low").alias("x"), F.col("high").alias("y")))
        about = ends.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        wide = ends.where("y > x").join(about, "x").select(F.col("y").alias("high"), F.col("m").alias("low")).where("high != low").distinct()
        under = wide.groupBy("high").agg(F.min("low").alias("m"))
        narrow = wide.join(under, "high").where("low != m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        links = narrow.unionByName(under.select("high", F.col("m").alias("low"))).distinct().checkpoint()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)
