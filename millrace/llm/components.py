"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage, unstage

MAX_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of edges(a, b); links of a node to itself and repeated links do no harm.

    A hub's links are never gathered: each star needs the least neighbour of a node, a partial minimum, joined back to its
    links, where Spark splits a hub's rows. Each round is written to the shared folder.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stage(links, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: greater neighbours go to the least of the node's own and its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u != v")
        # Small star: the node and its lesser neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        past, links = links, stage(small.where("u != v").distinct().toDF("a", "b"), "links")
        unstage(past)
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct()).toDF("node", "root")
