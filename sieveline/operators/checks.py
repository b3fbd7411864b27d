"""Checks of a build, its explanation, its plan and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, level: str, bad: DataFrame, what: Column) -> DataFrame:
    """(check, status, n, example): PASS without a bad row, else the level, how many, and the least of them."""
    found = bad.select(what.cast("string").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("example"))
    return found.select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise(level).alias("status"), "n", "example")


def verified(*checks: DataFrame) -> DataFrame:
    """All checks, and one row for the whole: the worst status there is."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    worst = F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status") == "WARN") > 0, "WARN").otherwise("PASS")
    whole = rows.agg(F.lit("all").alias("check"), worst.alias("status"), F.count_if(F.col("status") != "PASS").alias("n"), F.lit(None).cast("string").alias("example"))
    return rows.unionByName(whole)


def repeated(rows: DataFrame, *keys: Column) -> DataFrame:
    """The keys that several rows share, as `k`."""
    return rows.groupBy(F.concat_ws("|", *keys).alias("k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("k")


def absent(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the others."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def outside(rows: DataFrame, group: list[str], low: Column, high: Column, limits: DataFrame) -> DataFrame:
    """(group, n) of groups whose size is under or over their limits; a null limit is none."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    joined = limits.join(sizes, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.where((F.col("n") < low) | (F.col("n") > high)).select(*group, "n")


def sentences(rows: DataFrame, reason: str, texts: dict[str, str], *details: str) -> DataFrame:
    """rows with `sentence`: the reason's text with %s for each detail; reasons without a text speak for themselves."""
    said = F.coalesce(*(F.when(F.col(reason) == name, F.format_string(text, *(F.col(d) for d in details[: text.count("%")])) if "%" in text else F.lit(text)) for name, text in texts.items()), F.col(reason))
    return rows.withColumn("sentence", said)


def planned(picks: DataFrame, group: str, size: Column, seconds: Column, jobs: int) -> DataFrame:
    """(group, n, size, seconds, wall): what a build would take; wall is the same in all rows: the longest group, or all work shared."""
    rows = picks.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.sum(seconds).alias("seconds"))
    whole = rows.agg(F.greatest(F.max("seconds"), F.sum("seconds") / jobs).alias("wall"))
    return rows.crossJoin(F.broadcast(whole))  # one row


def fingerprints(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n, fingerprint): an order-independent digest of a group's rows, so that finished groups can be reused."""
    one = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(one).cast("string").alias("fingerprint"))


def reusable(now: DataFrame, finished: DataFrame, group: str) -> DataFrame:
    """(group, reuse): whether a group's fingerprint is the one it was finished with."""
    done = finished.select(group, F.col("fingerprint").alias("_f"))
    return now.join(done, group, "left").select(group, F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)).alias("reuse"))


def traits(items: DataFrame, cluster: str, means: list[str], medians: list[str], ranges: list[str], modes: list[str]) -> DataFrame:
    """One row a cluster: means, medians, lows and highs, and for each of `modes` the commonest value and its share.

    Ties of the commonest go to the least value. Values and their counts are partial sums; no cluster meets in one task.
    """
    out = items.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(c).alias(f"mean_{c}") for c in means),
        *(F.median(c).alias(f"median_{c}") for c in medians),
        *(f(c).alias(f"{name}_{c}") for c in ranges for name, f in (("low", F.min), ("high", F.max))),
    )
    for c in modes:
        counts = items.where(F.col(c).isNotNull()).groupBy(cluster, c).agg(F.count(F.lit(1)).alias("_c"))
        top = counts.groupBy(cluster).agg(F.max("_c").alias("_top"))
        best = counts.join(top, cluster).where("_c = _top").groupBy(cluster).agg(F.min(c).alias(f"mode_{c}"), F.max("_top").alias("_t"))
        out = out.join(best, cluster, "left").withColumn(f"share_{c}", F.col("_t") / F.col("n")).drop("_t")
    return out


def confusions(rows: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    """(a, b, n, examples) of rows where two sources differ: the n least keys of each pair, joined by commas."""
    apart = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    counts = apart.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    first = apart.withColumn("_r", F.row_number().over(Window.partitionBy(a, b).orderBy(key))).where(F.col("_r") <= n)
    lists = first.groupBy(a, b).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string"))).alias("examples"))
    return counts.join(lists, [a, b])


def sound_faults(measured: DataFrame, key: str, silent_db: float = -60.0, hot_db: float = 0.0, tail_s: float = 1.0) -> DataFrame:
    """The checks of exported sounds (key, level, silence_s, regularity, n_events and root, want_root): unreadable, silent,
    too hot, long silent tails, and roots that differ from what the name says by over half a semitone, octaves aside."""
    db = 20 * F.log10(F.greatest(F.col("level"), F.lit(1e-9)))
    off = F.abs(F.pmod(F.col("root") - F.col("want_root") + 6, F.lit(12)) - 6)
    what = F.col(key)
    return verified(
        check("unreadable", "FAIL", measured.where("level IS NULL"), what),
        check("silent", "FAIL", measured.where(F.col("level").isNotNull() & (db <= silent_db)), what),
        check("hot", "WARN", measured.where(F.col("level").isNotNull() & (db > hot_db)), what),
        check("tail", "WARN", measured.where(F.col("silence_s") > tail_s), what),
        check("root", "FAIL", measured.where(off > 0.5), what),
    )
