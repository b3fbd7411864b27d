"""Duplicates, moves and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keepers(items: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """items with `place` in their group: 1 is kept, the others are redundant. Null groups stand alone."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_seen(items: DataFrame, order: list[Column], *keys: str) -> DataFrame:
    """Keep the first of each key, one key after the other: a row that lost by the first key blocks nobody by the next."""
    for key in keys:
        placed = items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        items = placed.where(F.col(key).isNull() | (F.col("_n") == 1)).drop("_n")
    return items


def unified(items: DataFrame, group: str, key: str, home: str, prevails: str) -> DataFrame:
    """Copies share the home of the least key, or `prevails` if any copy has it. Rows without a group keep their own."""
    homes = items.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(home, key).alias("_home"), F.max((F.col(home) == prevails).cast("int")).alias("_any"))
    out = items.join(homes, group, "left")
    return out.withColumn(home, F.when(F.col("_any") == 1, prevails).otherwise(F.coalesce("_home", home))).drop("_home", "_any")


def moves(gone: DataFrame, new: DataFrame, key: str, on: list[str]) -> DataFrame:
    """(old, new) pairs that match one to one: neither side has another candidate. Counts, not windows, bound the work."""
    one_gone = gone.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("old")).where("_n = 1").drop("_n")
    one_new = new.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("new")).where("_n = 1").drop("_n")
    return one_gone.join(one_new, on).select("old", "new")


def mirrored(items: DataFrame, digest: str, is_mirror: Column) -> DataFrame:
    """Items of a mirror whose content also exists outside."""
    return items.where(is_mirror).join(items.where(~is_mirror).select(digest), digest, "left_semi")


def pruned(nodes: DataFrame, pairs: DataFrame, key: str, rank: str, write, most_rounds: int | None = None) -> DataFrame:
    """(key, kept, partner): greedy pruning by rank as a fixed-priority independent set.

    pairs (a, b): keys closer than the threshold. A node without an undecided or kept better neighbour is kept; a
    node with a kept better neighbour is dropped. That is what a loop over the ranks does, in a few rounds, each one
    join and one aggregation; each round decides the best undecided node at least, so rounds go on until none is left,
    and `most_rounds`, where given, raises. `write` materialises a round's table and returns it read again.
    """
    place = nodes.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    edges = pairs.join(place.toDF("a", "ra"), "a").join(place.toDF("b", "rb"), "b")
    down = write(edges.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("better"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("worse"), F.least("ra", "rb").alias("r")).distinct())
    state = write(place.select("k", F.lit(None).cast("boolean").alias("kept")))
    rounds, before = 0, None
    while undecided := state.where("kept IS NULL").count():
        if rounds == most_rounds or undecided == before:  # ranks that don't order the rows of a pair decide nothing
            raise RuntimeError(f"{undecided} rows are undecided after {rounds} rounds")
        rounds, before = rounds + 1, undecided
        seen = down.join(state.select(F.col("k").alias("better"), F.col("kept").alias("bk")), "better")
        told = seen.groupBy(F.col("worse").alias("k")).agg(F.max(F.coalesce("bk", F.lit(False))).alias("beaten"), F.max(F.col("bk").isNull()).alias("open"))
        state = write(state.join(told, "k", "left").select("k", F.coalesce("kept", F.when(F.col("beaten"), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
    best = down.join(state.where("kept").select(F.col("k").alias("better")), "better").groupBy(F.col("worse").alias("k")).agg(F.min_by("better", "r").alias("partner"))
    return state.join(best, "k", "left").select(F.col("k").alias(key), "kept", F.when(~F.col("kept"), F.col("partner")).alias("partner"))


def refilled(state: DataFrame, scores: DataFrame, key: str, floor: int) -> DataFrame:
    """state of `pruned` with `back`: while fewer than `floor` are kept, the dropped ones least like what is kept return.

    scores (a, b, score): the pairs that were pruned by. A dropped row is as like as its best score to a kept one.
    Only `floor` rows of the dropped ever meet in one sort.
    """
    kept = state.where("kept").select(F.col(key).alias("_k"))
    both = scores.select(F.col("a").alias("_d"), F.col("b").alias("_k"), "score").unionByName(scores.select(F.col("b").alias("_d"), F.col("a").alias("_k"), "score"))
    like = both.join(kept, "_k").groupBy("_d").agg(F.max("score").alias("_like"))
    have = kept.agg(F.count(F.lit(1)).alias("_n"))
    out = state.where("NOT kept").join(like, F.col(key) == F.col("_d"), "left").select(key, "_like")
    first = out.orderBy(F.asc_nulls_first("_like"), key).limit(floor)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("_like"), key))
    back = first.withColumn("_r", place).crossJoin(F.broadcast(have)).where(F.col("_r") <= floor - F.col("_n")).select(key, F.lit(True).alias("back"))  # one row
    return state.join(back, key, "left").withColumn("back", F.coalesce("back", F.lit(False)))
