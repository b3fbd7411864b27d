"""Paths through parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written


def paths(nodes: DataFrame, key: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """(key, path, depth) of every node of a table of parent pointers; roots have a null parent.

    Pointers are doubled: a round joins each node to what it points at and takes over its path and pointer, so a tree
    of depth d is done in log2(d) rounds. A node whose parent is not there is a root. Nodes on a cycle, or below one,
    never come to an end: after as many rounds as their number allows they have null for a path.
    """
    rows = nodes.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.col(name).alias("path"), F.lit(1).cast("long").alias("depth"))
    known = rows.select(F.col("k").alias("up"))
    rows = written(rows.join(known.withColumn("_there", F.lit(True)), "up", "left").select("k", F.when(F.col("_there"), F.col("up")).alias("up"), "path", "depth"), "paths")
    for _ in range(rows.count().bit_length() + 1):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        ahead = rows.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("more"))
        joined = rows.join(ahead, "up", "left")
        # paths on a cycle would double in every round, so they stop growing where no tree could be as deep
        path = F.when(F.col("head").isNotNull(), F.concat("head", F.lit(separator), "path")).otherwise(F.col("path"))
        rows = written(joined.select("k", F.col("next").alias("up"), F.when(F.length(path) <= 1 << 20, path).otherwise(F.lit("")).alias("path"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "paths")
    open_ = F.col("up").isNotNull()
    return rows.select(F.col("k").alias(key), F.when(~open_, F.col("path")).alias("path"), F.when(~open_, F.col("depth")).alias("depth"))


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, steps): where a chain of pointers ends, by doubling; chains that run in a circle have a null root."""
    rows = nodes.select(F.col(key).alias("k"), F.when(F.col(parent) != F.col(key), F.col(parent)).alias("up"), F.lit(0).cast("long").alias("steps"))
    there = rows.select(F.col("k").alias("up"), F.lit(True).alias("_there"))
    rows = rows.join(there, "up", "left").select("k", F.when(F.col("_there"), F.col("up")).alias("up"), "steps")
    rows = written(rows.select("k", F.coalesce("up", "k").alias("at"), F.col("up").isNotNull().alias("open"), F.col("up").isNotNull().cast("long").alias("steps")), "roots")
    for _ in range(rows.count().bit_length() + 1):
        if rows.where("open").isEmpty():
            break
        ahead = rows.select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("open").alias("more"), F.col("steps").alias("far"))
        rows = written(rows.join(ahead, "at").select("k", F.col("next").alias("at"), (F.col("open") & F.col("more")).alias("open"), (F.col("steps") + F.when(F.col("open"), F.col("far")).otherwise(0)).alias("steps")), "roots")
    return rows.select(F.col("k").alias(key), F.when(~F.col("open"), F.col("at")).alias("root"), F.when(~F.col("open"), F.col("steps")).alias("steps"))
