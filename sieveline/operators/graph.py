"""Connected components by alternating star contraction over an edge table; nothing gathers on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written


def components(nodes: DataFrame, links: DataFrame, key: str, most_rounds: int = 60) -> DataFrame:
    """(key, component): the least key reachable. Nodes without links are their own; links may repeat or loop.

    A large-star round joins every larger neighbour to the least one, a small-star round the smaller ones. Both
    group by a node's key, where a node with many links meets only as a minimum: the pairs are dealt by a join.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        paired = large.join(small_least, "hi")
        small = paired.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        edges = written(small, "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.groupBy(F.col("hi").alias("_k")).agg(F.min("lo").alias("_m"))
    return nodes.join(roots, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_m", F.col(key).cast("long")).alias("component"))
