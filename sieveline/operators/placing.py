"""Places in numbered folders, sets and plans: ranks, quotas, twins, moves and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def numbered_folders(items: DataFrame, folder: str, order: list[Column], room: int) -> DataFrame:
    """items with `sibling`: the numbered folder (from 1) they go to when each holds `room` items."""
    rows = ranked(items, folder, order)
    return rows.select(*items.columns, (F.floor((F.col("_r") - 1) / room) + 1).cast("int").alias("sibling"))


def evenly_spread(items: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """At most `cap` rows a group, evenly spaced along the order; whole groups where they fit, and all rows without a group."""
    whole = items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked(items.where(F.col(group).isNotNull()), group, order).join(whole, group)
    step = lambda r: F.floor(r * F.lit(cap) / F.col("_n"))
    picked = rows.where((F.col("_n") <= cap) | (step(F.col("_r")) != step(F.col("_r") - 1)))
    return picked.select(*items.columns).unionByName(items.where(F.col(group).isNull()))


def one_each(items: DataFrame, keys: list[str], best: list[Column], pinned: Column) -> DataFrame:
    """The best row of each key and every pinned one; rows with a null in the key stay."""
    free = pinned
    for k in keys:
        free = free | F.col(k).isNull()
    free = F.coalesce(free, F.lit(False))
    rows = items.withColumns({"_free": free, "_r": F.row_number().over(Window.partitionBy(*keys).orderBy(*best))})
    return rows.where(F.col("_free") | (F.col("_r") == 1)).select(*items.columns)


def quota(items: DataFrame, groups: list[str], order: list[Column], most: Column) -> DataFrame:
    """The first rows of each group up to a quota that may differ by row."""
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_r") <= most).drop("_r")


def examples(items: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(group, count, examples): how many rows, and the n least keys as a list joined by commas.

    Groups are dealt by a salt first, so that a list of at most 64 n keys is all that meets.
    """
    counts = items.groupBy(group).agg(F.count(F.lit(1)).alias("count"))
    first = items.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_s").orderBy(key))).where(F.col("_r") <= n)
    lists = first.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).alias("_l"))
    return counts.join(lists, counts[group].eqNullSafe(lists[group])).select(counts[group], "count", F.array_join(F.col("_l").cast("array<string>"), ",").alias("examples"))


def twins(items: DataFrame, key: str, digest: str, chosen: Column) -> DataFrame:
    """(key, twins): how many other items of the same content are chosen; only items that have one."""
    seen = items.where(chosen & F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return items.join(seen, digest).select(key, (F.col("_n") - own).alias("twins")).where(F.col("twins") > 0)


def rekeyed(orphans: DataFrame, files: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """(old, new, how) for orphans whose content lives on: the one file of the same name, else the one file there is."""
    named = files.groupBy(digest, name).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias("_a")).where("_c = 1").drop("_c")
    single = files.groupBy(digest).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias("_b")).where("_c = 1").drop("_c")
    found = orphans.select(F.col(key).alias("old"), digest, name).join(named, [digest, name], "left").join(single, digest, "left")
    how = F.when(F.col("_a").isNotNull(), "name").when(F.col("_b").isNotNull(), "only").otherwise("lost")
    return found.select("old", F.coalesce("_a", "_b").alias("new"), how.alias("how"))


def device_plan(lock: DataFrame, now: DataFrame, key: str, digest: str, kind: str) -> DataFrame:
    """(key, action): kept, changed, retired, new, or duplicate for a new row with a retired row's kind and content."""
    a = lock.select(F.col(key).alias("_ka"), F.col(digest).alias("_da"), F.col(kind).alias("_ta"))
    b = now.select(F.col(key).alias("_kb"), F.col(digest).alias("_db"), F.col(kind).alias("_tb"))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full")
    action = F.when(F.col("_ka").isNull(), "new").when(F.col("_kb").isNull(), "retired").when(F.col("_da") == F.col("_db"), "kept").otherwise("changed")
    rows = both.select(F.coalesce("_ka", "_kb").alias(key), F.coalesce("_ta", "_tb").alias("_t"), F.coalesce("_da", "_db").alias("_d"), action.alias("_x"))
    gone = rows.where("_x = 'retired'").select(F.col("_t").alias("_gt"), F.col("_d").alias("_gd")).distinct()
    told = rows.join(gone, (F.col("_t") == F.col("_gt")) & (F.col("_d") == F.col("_gd")), "left")
    return told.select(key, F.when((F.col("_x") == "new") & F.col("_gd").isNotNull(), "duplicate").otherwise(F.col("_x")).alias("action"))


def superset(base: DataFrame, found: DataFrame, group: str, key: str, order: list[Column], allowance: int) -> DataFrame:
    """(group, key, origin): all of the base, and up to `allowance` found rows a group that the base has not."""
    fresh = found.join(base.select(group, key), [group, key], "left_anti")
    added = quota(fresh, [group], order, F.lit(allowance)).select(group, key, F.lit("added").alias("origin"))
    return base.select(group, key, F.lit("base").alias("origin")).unionByName(added)


def guard(known: DataFrame, seen: DataFrame, key: str, share: float = 0.2, least: int = 10) -> DataFrame:
    """(known, gone, blocked): too many missing at once stop a prune."""
    gone = known.join(seen.select(F.col(key), F.lit(1).alias("_here")).distinct(), key, "left")
    counts = gone.agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("_here").isNull()).alias("gone"))
    return counts.withColumn("blocked", (F.col("gone") >= least) & (F.col("gone") > F.lit(share) * F.col("known")))


def changes(old: DataFrame, new: DataFrame, key: str, why: DataFrame) -> DataFrame:
    """(key, change, reason): joined and left files; what left carries its reason where one is on record."""
    left = old.select(key).join(new, key, "left_anti").join(why.select(key, "reason"), key, "left")
    joined = new.select(key).join(old, key, "left_anti")
    return left.select(key, F.lit("left").alias("change"), "reason").unionByName(joined.select(key, F.lit("joined").alias("change"), F.lit(None).cast("string").alias("reason")))


def wall_seconds(costs: DataFrame, seconds: str, jobs: int, fixed: float) -> DataFrame:
    """(work, longest, wall): the longest part or the work shared by the jobs, and what any run costs."""
    sums = costs.agg(F.sum(seconds).alias("work"), F.max(seconds).alias("longest"))
    return sums.withColumn("wall", F.greatest(F.col("longest"), F.col("work") / jobs) + F.lit(fixed))


def rhythm(events: DataFrame, key: str, at: Column, level: str, tie: str, step: float) -> DataFrame:
    """(key, n, regularity, echo): the deviation of the gaps between starts over their mean (three at least), and
    whether every event is quieter than the one before by a step."""
    w = Window.partitionBy(key).orderBy("_at", tie)
    rows = events.withColumn("_at", at).select(key, "_at", tie, F.col(level).alias("_v"))
    rows = rows.withColumns({"_gap": F.col("_at") - F.lag("_at").over(w), "_fall": F.col("_v") < F.lag("_v").over(w) - F.lit(step)})
    stats = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_gap").alias("_s"), F.avg("_gap").alias("_m"), F.coalesce(F.bool_and("_fall"), F.lit(False)).alias("echo"))
    return stats.select(key, "n", F.when(F.col("n") >= 3, F.col("_s") / (F.col("_m") + 1e-9)).alias("regularity"), "echo")
