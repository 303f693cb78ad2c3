"""Connected components of an edge table by alternating stars, with partial aggregation and materialized steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (columns a, b of one ordered type).

    Large stars tie each node's greater neighbours to its least one, small stars its smaller ones; the two alternate until
    the edges stay the same, which takes few rounds. Null ends and loops are left out."""
    edges = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges")
    before, size = None, edges.count()
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = materialize(large, "large", 2 * size)
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        edges = small.select(F.col("y").alias("p"), "m").unionByName(least.select(F.col("x").alias("p"), "m")).where("p <> m").select(F.col("m").alias("u"), F.col("p").alias("v")).distinct()
        edges = materialize(edges, "small", 2 * size)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    own = edges.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    roots = edges.select(F.col("u").alias("node")).distinct().join(own.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return own.unionByName(roots)
