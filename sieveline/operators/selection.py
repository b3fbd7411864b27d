"""Gates with reasons, caps, budgets and group measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def gated(items: DataFrame, *gates: tuple[str, Column]) -> DataFrame:
    """items with `reason`: the first gate that shuts (a null condition lets pass), null for what is kept."""
    reason = F.lit(None).cast("string")
    for name, shut in reversed(gates):
        reason = F.when(shut, name).otherwise(reason)
    return items.withColumn("reason", reason)


def share_capped(items: DataFrame, group: str, key: str, share: float, least_groups: int = 3, seed: int = 0) -> DataFrame:
    """No group over a share of the rest: round(s / (1 - s) * (n - g)) rows of it stay, by a seeded hash.

    Nothing is capped under `least_groups` groups or where no group exceeds the share; rows without a group never are.
    Sizes are a small table by group; the ranking is by group, and runs only over groups that exceed.
    """
    sizes = items.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_g"))
    whole = sizes.agg(F.sum("_g").alias("_n"), F.count(F.lit(1)).alias("_groups"), F.max("_g").alias("_top"))
    target = F.greatest(F.lit(1), F.round(F.lit(share / (1 - share)) * (F.col("_n") - F.col("_g"))).cast("long"))
    act = (F.col("_groups") >= least_groups) & (F.col("_top") > share * F.col("_n"))
    over = sizes.crossJoin(F.broadcast(whole)).where(act & (F.col("_g") > target)).select(group, target.alias("_t"))
    marked = items.join(over, group, "left")
    loose = marked.where("_t IS NULL")
    tight = ranked(marked.where("_t IS NOT NULL"), group, [F.xxhash64(F.lit(seed), key), F.col(key)]).where("_r <= _t").drop("_r")
    return loose.unionByName(tight).select(*items.columns)


def group_capped(items: DataFrame, group: str, cap: int, order: list[Column]) -> DataFrame:
    """At most `cap` rows a group; rows without a group are free."""
    # a row_number under a constant is a limit by group: each task passes on `cap` rows of a group at most
    some = items.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
    return items.where(F.col(group).isNull()).unionByName(some)


def budgeted(sizes: DataFrame, name: str, size: str, budget: int, floor: int, ceil: int) -> DataFrame:
    """(name, size, share): proportional, at least the floor and at most the ceiling; the pool bounds both."""
    total = F.sum(size).over(Window.partitionBy(F.lit(1)))
    share = F.round(F.lit(float(budget)) * F.col(size) / total).cast("long")
    return sizes.select(name, size, F.least(F.least(F.lit(ceil), F.col(size)), F.greatest(F.least(F.lit(floor), F.col(size)), share)).cast("long").alias("share"))


def apportioned(sizes: DataFrame, name: str, size: str, budget: int, floor: int, ceil: int) -> DataFrame:
    """(name, size, share) that meet the budget as far as floors and ceilings let them.

    `budgeted` gives the shares to begin with. Every unit that a family could still take is a row valued by what the
    family would then still leave out, every unit that it could give back a row valued by its share before; as many of
    the best units as the budget is off are taken or given. So nothing is looped over: one sort of at most
    (ceil - floor) rows for each family. Ties go to the larger family, then to the lesser name.
    """
    base = budgeted(sizes, name, size, budget, floor, ceil)
    off = base.agg((F.lit(budget) - F.sum("share")).alias("_off"))  # one row
    least, most, share = F.least(F.lit(floor), F.col(size)), F.least(F.lit(ceil), F.col(size)), F.col("share")
    empty = F.array().cast("array<bigint>")
    take = F.when(most > share, F.sequence(F.col(size) - most + 1, F.col(size) - share)).otherwise(empty)
    give = F.when(share > least, F.sequence(least + 1, share)).otherwise(empty)
    units = base.crossJoin(F.broadcast(off)).select(name, size, "_off", F.explode(F.when(F.col("_off") > 0, take).when(F.col("_off") < 0, give)).alias("_unit"))
    best = units.withColumn("_r", F.row_number().over(Window.partitionBy(F.signum("_off")).orderBy(F.desc("_unit"), F.desc(size), name))).where(F.col("_r") <= F.abs("_off"))
    moved = best.groupBy(name).agg(F.sum(F.signum("_off")).cast("long").alias("_d"))
    return base.join(moved, name, "left").select(name, size, (share + F.coalesce("_d", F.lit(0))).alias("share"))


def quiet_members(items: DataFrame, folder: str, level: str, decibels: float = 20.0, least: int = 3) -> DataFrame:
    """Items a number of decibels under their folder's median level, in folders of at least `least`."""
    medians = items.groupBy(folder).agg(F.median(level).alias("_m"), F.count(level).alias("_n")).where(F.col("_n") >= least)
    low = 20 * F.log10(F.col(level) / F.col("_m")) <= -decibels
    return items.join(medians, folder).where((F.col(level) > 0) & low).select(*items.columns)


def soft_layers(items: DataFrame, group: str, peak: str, under: float, louder: float) -> DataFrame:
    """Items under a peak while a sibling is louder by a margin."""
    tops = items.groupBy(group).agg(F.max(peak).alias("_top"))
    return items.join(tops, group).where((F.col(peak) < under) & (F.col("_top") >= F.col(peak) + louder)).select(*items.columns)


def readmitted(items: DataFrame, margin: str, key: str, floor: int) -> DataFrame:
    """items with `reason` from `gated`: the best gated rows return until `floor` are kept."""
    kept = items.where("reason IS NULL").agg(F.count(F.lit(1)).alias("_k"))
    back = items.where("reason IS NOT NULL").orderBy(F.desc_nulls_last(margin), key).limit(floor)
    ranked = back.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(margin), key)))
    back = ranked.crossJoin(F.broadcast(kept)).where(F.col("_r") <= floor - F.col("_k")).drop("_r", "_k")
    return items.where("reason IS NULL").unionByName(back)
