"""Connected components of link tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import remove, scratch_dir, stash

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked node with the smallest node that it can reach.

    Each round moves every neighbour to the smallest one around it, so stars flatten in a few rounds and chains in
    about the logarithm of their length. Rounds are written to shared storage; nothing but a count reaches the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    spark, where = links.sparkSession, scratch_dir(links.sparkSession)
    edges = stash(edges, where)
    for _ in range(MAX_ROUNDS):
        # large star: neighbours above a node go to the smallest node in its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, where = where, scratch_dir(spark)
        edges = stash(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), where)
        remove(spark, last)
        # done once all are stars: no node has two links down, and none with a link down has one from above
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        open_ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where((F.col("down") > 1) | (F.col("down") + F.col("up") > 1))
        if open_ends.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
