"""Gap sessions and incremental upserts, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, starts, ends, n): runs without a gap of more than the seconds; a user's runs are numbered from 1."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    apart = F.col(at).cast("timestamp").cast("double") - F.lag(at).over(order).cast("timestamp").cast("double")
    cut = events.withColumn("_new", F.when(apart.isNull() | (apart > gap_seconds), 1).otherwise(0))
    numbered = cut.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("starts"), F.max(at).alias("ends"), F.count(F.lit(1)).alias("n"))


def streamed_sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """The same on a stream: sessions close when the watermark has passed their gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def upserted(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version wins, of the table and a batch of changes."""
    both = stored.unionByName(changes, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
