"""Ranks within groups of any size: by ranges of the whole order, not by one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written


def ranked(items: DataFrame, group: str, order: list[Column], name: str = "_r") -> DataFrame:
    """items with `name`: the place (from 1) of each row in its group, by an order that should end in a key.

    Rows are dealt to ranges of (group, order), numbered within group and range, and moved up by how many rows of the
    group lie in the ranges before. Only one count for each group and range meets in a window, so that a group that
    holds a third of all rows is spread over many tasks. Null groups are ranked like any other.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartitionByRange(parts, F.col(group).asc_nulls_first(), *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_ahead"))
    near = dealt.withColumn(name, F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    joined = near.join(ahead, near[group].eqNullSafe(ahead["_g"]) & (near["_part"] == ahead["_p"]))
    return joined.select(*items.columns, (F.col(name) + F.col("_ahead")).alias(name))
