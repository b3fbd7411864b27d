"""Comparisons of snapshots, releases, ratings and device plans: one full outer join each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outer(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, o, n): the rows of both sides as structs."""
    o = old.select(F.col(key).alias("_ko"), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key).alias("_kn"), F.struct(*new.columns).alias("n"))
    return o.join(n, o["_ko"] == n["_kn"], "full_outer").select(F.coalesce("_ko", "_kn").alias(key), "o", "n")


def sync_actions(known: DataFrame, seen: DataFrame, key: str, stamp: str, digest: str) -> DataFrame:
    """(key, action): new, removed, changed (other stamp), retry (no digest yet) or unchanged."""
    both = outer(known, seen, key)
    action = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col(f"o.{stamp}").eqNullSafe(F.col(f"n.{stamp}")), "changed").when(F.col(f"o.{digest}").isNull(), "retry").otherwise("unchanged")
    return both.select(key, action.alias("action"))


def release_plan(base: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed, moved (its content is new elsewhere), unchanged or unverified."""
    both = outer(base, now, key).select(key, F.col(f"o.{digest}").alias("was"), F.col(f"n.{digest}").alias("is"), F.col("o").isNotNull().alias("here"), F.col("n").isNotNull().alias("there"))
    arrived = both.where("NOT here AND is IS NOT NULL").select(F.col("is").alias("was")).distinct().withColumn("elsewhere", F.lit(True))
    both = both.join(arrived, "was", "left")
    change = F.when(~F.col("here"), "added").when(~F.col("there"), F.when(F.col("elsewhere"), "moved").otherwise("removed")).when(F.col("was").isNull() | F.col("is").isNull(), "unverified").when(F.col("was") != F.col("is"), "changed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def families(old: DataFrame, new: DataFrame, family: str, item: str, share: float = 0.5) -> DataFrame:
    """(family, matched, overlap, status) of the new families: same, renamed or new, by the share of shared items."""
    sizes = new.groupBy(family).agg(F.count(F.lit(1)).alias("size"))
    both = new.join(old.select(F.col(item), F.col(family).alias("was")), item).groupBy(family, "was").agg(F.count(F.lit(1)).alias("n"))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(F.desc("n"), "was"))).where("_r = 1")
    out = sizes.join(best.select(family, "was", "n"), family, "left").withColumn("overlap", F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)))
    fits = F.col("overlap") >= share
    return out.select(family, F.when(fits, F.col("was")).alias("matched"), "overlap", F.when(~fits, "new").when(F.col("was") == F.col(family), "same").otherwise("renamed").alias("status"))


def field_changes(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, was, now): differences field by field; gone and new keys have the field `row`."""
    both = outer(a, b, key)
    one = F.struct(F.lit("row").alias("field"), F.when(F.col("o").isNotNull(), "there").alias("was"), F.when(F.col("n").isNotNull(), "there").alias("now"))
    each = [F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("was"), F.col(f"n.{c}").cast("string").alias("now")) for c in columns]
    alone = F.col("o").isNull() | F.col("n").isNull()
    rows = both.select(key, F.explode(F.when(alone, F.array(one)).otherwise(F.array(*each))).alias("f"))
    return rows.select(key, "f.*").where(~F.col("was").eqNullSafe(F.col("now")))


def merged_ratings(stored: DataFrame, found: DataFrame, key: str, verdict: str, priority: list[str]) -> DataFrame:
    """One verdict a key: what differs from the stored one first, then by priority, then the latest."""
    now = found.join(stored.select(F.col(key), F.col(verdict).alias("_was")), key, "left")
    rank = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col(verdict))
    best = now.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(verdict).eqNullSafe(F.col("_was")), rank, F.desc("at"), F.desc("tie")))).where("_r = 1")
    return stored.select(F.col(key).alias("_k"), F.col(verdict).alias("_s")).join(best.select(key, verdict), F.col("_k") == F.col(key), "full_outer").select(F.coalesce(key, "_k").alias(key), F.coalesce(verdict, "_s").alias(verdict))
