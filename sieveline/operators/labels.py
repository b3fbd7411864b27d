"""Labels and descriptors as long tables: nesting, widening, vocabulary, membership, stamps and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(items: DataFrame, key: str, lists: str, provider: str, kind: str) -> DataFrame:
    """A list column as (key, provider, kind, label, rank)."""
    return items.select(key, F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), F.posexplode(lists).alias("rank", "label"))


def nested(items: DataFrame, labels: DataFrame, key: str, covered: DataFrame | None = None) -> DataFrame:
    """items with `labels`, by rank; [] where covered and none, null where the provider never saw the item."""
    lists = labels.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))
    out = items.join(lists, key, "left")
    empty = F.array().cast("array<string>")
    if covered is None:
        return out.withColumn("labels", F.coalesce("labels", empty))
    seen = covered.select(key).distinct().withColumn("_seen", F.lit(True))
    return out.join(seen, key, "left").withColumn("labels", F.when(F.col("_seen"), F.coalesce("labels", empty))).drop("_seen")


def widened(descriptors: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column for each descriptor name: one aggregation instead of a join for each."""
    return descriptors.groupBy(key).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def canonical(labels: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(key, canonical, rank): the least rank of the raw labels that map to it."""
    return labels.join(mapping, "label").groupBy(key, "canonical").agg(F.min("rank").alias("rank"))


def unmapped(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    return labels.join(mapping, "label", "left_anti").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


def having_any(items: DataFrame, labels: DataFrame, key: str, like: Column) -> DataFrame:
    """Items with a label that fits; a semi-join, so an item counts once."""
    return items.join(labels.where(like).select(key), key, "left_semi")


def parity(source: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(field, differs, source_only, stored_only): null-safe comparison of two tables by key."""
    a = source.select(key, F.lit(True).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = stored.select(F.col(key).alias("_k"), F.lit(True).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = a.join(b, a[key] == b["_k"], "full_outer")
    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), (here & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("d")) for c in columns)))
    rows = both.select("_a", "_b", fields.alias("f"))
    return rows.groupBy("f.field").agg(F.count_if("f.d").alias("differs"), F.count_if(F.col("_b").isNull()).alias("source_only"), F.count_if(F.col("_a").isNull()).alias("stored_only"))


def stale(now: DataFrame, stored: DataFrame, key: str, columns: list[str], version: int) -> DataFrame:
    """(key, action): relabel where the stamp of version and columns differs, delete where the item is gone."""
    stamp = F.xxhash64(F.lit(version), *columns)
    a = now.select(key, stamp.alias("_new"))
    b = stored.select(F.col(key).alias("_k"), F.col("stamp").alias("_old"))
    both = a.join(b, a[key] == b["_k"], "full_outer")
    action = F.when(F.col(key).isNull(), "delete").when(~F.col("_new").eqNullSafe(F.col("_old")), "relabel")
    return both.select(F.coalesce(key, "_k").alias(key), action.alias("action")).where("action IS NOT NULL")


def stood_in(items: DataFrame, tags: DataFrame, words: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(key, tag, origin): a provider's tags, and, for items it has none of, the tags that words of their path map to.

    tags (key, tag), words (key, word), mapping (word, tag); each pair once.
    """
    own = items.select(key).join(tags.select(key, "tag"), key).distinct()
    bare = items.select(key).join(own.select(key), key, "left_anti")
    read = bare.join(words.select(key, "word"), key).join(mapping, "word").select(key, "tag").distinct()
    return own.select(key, "tag", F.lit("provider").alias("origin")).unionByName(read.select(key, "tag", F.lit("words").alias("origin")))
