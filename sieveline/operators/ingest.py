"""Imports: scans with pushed-down filters, content hashes, change states, missing marks, caches and provider upkeep."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(rows: DataFrame, *, types: tuple[str, Iterable[str]] | None = None, flags: Iterable[str] = (), ranges: dict[str, tuple[float | None, float | None]] | None = None, lists: dict[str, Iterable[str]] | None = None, status: tuple[str, str] | None = None) -> DataFrame:
    """The rows that pass every filter given: a type of several, set flags, ranges, lists that hold one of several, a status.

    Comparisons drop nulls, and are plain predicates, so that types, flags, ranges and the status reach the file scan.
    """
    if types:
        rows = rows.where(F.col(types[0]).isin(*types[1]))
    for flag in flags:
        rows = rows.where(F.col(flag))
    for name, (low, high) in (ranges or {}).items():
        rows = rows if low is None else rows.where(F.col(name) >= low)
        rows = rows if high is None else rows.where(F.col(name) <= high)
    for name, values in (lists or {}).items():
        rows = rows.where(F.arrays_overlap(name, F.array(*(F.lit(v) for v in values))))
    return rows.where(F.col(status[0]) == status[1]) if status else rows


def child_tags(items: DataFrame, tags: DataFrame, paths: DataFrame, key: str, tag: str, deleted: str) -> DataFrame:
    """(key, tags) of items: the sorted distinct paths of their tags that are not deleted; [] without any."""
    live = tags.where(~F.coalesce(deleted, F.lit(False))).select(key, tag).distinct().join(paths, tag)
    lists = live.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("tags"))
    return items.select(key).join(lists, key, "left").select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def hashed(files: DataFrame, key: str, content: str, head: int = 8192, digits: int = 16) -> DataFrame:
    """(key, quick_hash, file_hash): a digest of the first bytes, and one of all bytes only where quick hashes collide.

    Rows without content have neither. Colliding hashes are a grouped semi-join, so contents are read once and only
    those that collide are hashed whole.
    """
    body = F.col(content).cast("binary")
    quick = files.where(F.col(content).isNotNull()).select(key, content, F.substring(F.sha2(F.substring(body, 1, head), 256), 1, digits).alias("quick_hash"))
    twice = quick.groupBy("quick_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("quick_hash", F.lit(True).alias("_twice"))
    found = quick.join(twice, "quick_hash", "left").select(key, "quick_hash", F.when(F.col("_twice"), F.substring(F.sha2(body, 256), 1, digits)).alias("file_hash"))
    return files.select(F.col(key).alias("_k")).join(found, F.col("_k") == F.col(key), "left").select(F.col("_k").alias(key), "quick_hash", "file_hash")


def known_changes(known: DataFrame, seen: DataFrame, key: str, group: str, many: int = 20, share: float = 0.8) -> DataFrame:
    """(key, state) of files that are known and still there; both sides have size, modified, quick_hash and file_hash.

    same: size and time are as before; touched: only the time moved and the content is the same; copied: so do most
    times of its group (a restored or copied library says nothing about its files); changed: size or content differ;
    unsure: the time moved and a hash is missing.
    """
    a = known.select(F.col(key).alias("_k"), F.struct("size", "modified", "quick_hash", "file_hash").alias("o"))
    both = seen.join(a, F.col(key) == F.col("_k")).withColumn("_moved", ~F.col("modified").eqNullSafe(F.col("o.modified")))
    groups = both.groupBy(group).agg((F.count_if("_moved") >= many).alias("_many"), (F.count_if("_moved") >= share * F.count(F.lit(1))).alias("_most"))
    rows = both.join(groups, group, "left")
    hashes = F.coalesce(F.col("file_hash") == F.col("o.file_hash"), F.col("quick_hash") == F.col("o.quick_hash"))
    state = (
        F.when(F.col("size") != F.col("o.size"), "changed")
        .when(~F.col("_moved"), "same")
        .when(~hashes, "changed")
        .when(F.col("_many") & F.col("_most"), "copied")
        .when(hashes, "touched")
        .otherwise("unsure")
    )
    return rows.select(key, state.alias("state"))


def missing_marks(items: DataFrame, seen: DataFrame, marks: DataFrame, moves: DataFrame, key: str, day: Column) -> DataFrame:
    """(key, since, moved_to, event): the new table of missing items and what became of the old one.

    event: newly, still or again found; marks of items that no longer exist are dropped. moved_to comes from `moves`
    (key, to) where the item lives on elsewhere.
    """
    here = seen.select(F.col(key).alias("_s")).distinct()
    old = marks.select(F.col(key).alias("_m"), F.col("since").alias("_since"))
    rows = items.select(key).join(here, F.col(key) == F.col("_s"), "left").join(old, F.col(key) == F.col("_m"), "left").join(moves.select(F.col(key).alias("_v"), "to"), F.col(key) == F.col("_v"), "left")
    gone, was = F.col("_s").isNull(), F.col("_m").isNotNull()
    event = F.when(gone & was, "still").when(gone, "newly").when(was, "again found")
    return rows.withColumn("event", event).where("event IS NOT NULL").select(key, F.when(gone, F.coalesce("_since", day)).alias("since"), F.when(gone, F.col("to")).alias("moved_to"), "event")


def looked_up(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, answer): hit, negative (a result is known not to exist) or miss."""
    held = cache.select(key, F.lit(True).alias("_held"), F.col("result").isNotNull().alias("_some"))
    return keys.select(key).distinct().join(held, key, "left").select(key, F.when(F.col("_held") & F.col("_some"), "hit").when(F.col("_held"), "negative").otherwise("miss").alias("answer"))


def expired(cache: DataFrame, linked: DataFrame, key: str, used: str, before: Column) -> DataFrame:
    """The entries that no result links to and nobody has used since."""
    return cache.join(linked.select(key), key, "left_anti").where(F.col(used) < before)


def freshness(wanted: DataFrame, providers: DataFrame, covered: DataFrame, key: str, rebuild_share: float = 0.5) -> DataFrame:
    """(provider, action, todo, gone): rebuild where most items lack it, update where some do or some are gone, else current.

    wanted (key), providers (provider), covered (provider, key). A provider that covers nothing is rebuilt.
    """
    whole = wanted.agg(F.count_distinct(key).alias("whole"))
    marked = covered.select("provider", key).distinct().join(wanted.select(key, F.lit(True).alias("_w")).distinct(), key, "left")
    counts = marked.groupBy("provider").agg(F.count_if(F.col("_w")).alias("has"), F.count_if(F.col("_w").isNull()).alias("gone"))
    rows = providers.select("provider").distinct().join(counts, "provider", "left").crossJoin(F.broadcast(whole))  # one row
    rows = rows.select("provider", (F.col("whole") - F.coalesce("has", F.lit(0))).alias("todo"), F.coalesce("gone", F.lit(0)).alias("gone"), "whole")
    action = F.when(F.col("todo") > rebuild_share * F.col("whole"), "rebuild").when((F.col("todo") > 0) | (F.col("gone") > 0), "update").otherwise("current")
    return rows.select("provider", action.alias("action"), "todo", "gone")


def ratings_after(store: DataFrame, cleared: DataFrame, moved: DataFrame, misfiled: DataFrame, key: str, margin: float = 0.4) -> DataFrame:
    """(key, verdict, origin): the ratings after keys were cleared and moved, and misfiles found by a wide margin.

    A moved rating never overwrites one that is there; a detection never overwrites a rating.
    """
    left = store.join(cleared.select(key), key, "left_anti")
    to = left.join(moved.select(key, "to"), key, "left").select(F.coalesce("to", key).alias(key), "verdict", F.col("to").isNotNull().alias("_m"))
    one = to.groupBy(key).agg(F.min(F.struct("_m", "verdict")).alias("b")).select(key, "b.verdict", F.when(F.col("b._m"), "moved").otherwise("kept").alias("origin"))
    found = misfiled.where(F.col("margin") > margin).select(key).distinct().join(one.select(key), key, "left_anti")
    return one.unionByName(found.select(key, F.lit("misfiled").alias("verdict"), F.lit("detected").alias("origin")))


def followed(locked: DataFrame, files: DataFrame, key: str, ways: list[list[str]]) -> DataFrame:
    """(old, new, way) of locked rows whose file is gone: one way of matching after the other, only where both sides are alone.

    What one way matched takes no part in the next; a null in a way's columns matches nothing.
    """
    gone, new = locked.join(files.select(key), key, "left_anti"), files.join(locked.select(key), key, "left_anti")
    out = None
    for at, on in enumerate(ways):
        one_gone = gone.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("old")).where("_n = 1").drop("_n")
        one_new = new.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("new")).where("_n = 1").drop("_n")
        found = one_gone.join(one_new, on).select("old", "new", F.lit(at + 1).alias("way"))
        gone = gone.join(found.select(F.col("old").alias(key)), key, "left_anti")
        new = new.join(found.select(F.col("new").alias(key)), key, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out
