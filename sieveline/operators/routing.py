"""Candidates, votes, homes and what a sound alone says."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def candidates(items: DataFrame, key: str, rules: dict[str, Column], also: DataFrame | None = None) -> DataFrame:
    """(key, category): every category whose predicate holds, and the pairs of `also` (pins, overrides), each once."""
    named = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
    out = items.select(key, F.explode(named).alias("category"))
    return out if also is None else out.unionByName(also.select(key, "category")).distinct()


def homes(votes: DataFrame, key: str, sources: int, tie: DataFrame | None = None) -> DataFrame:
    """(key, home, support, conflict) of votes (key, source, category).

    The category that most sources vote for; ties by the score of `tie` (key, category, score), then by the last name.
    conflict: all sources vote and no category has two of them.
    """
    cast = votes.select(key, "source", "category").distinct()
    by = cast.groupBy(key, "category").agg(F.count(F.lit(1)).alias("support"))
    by = by.join(tie, [key, "category"], "left") if tie is not None else by.withColumn("score", F.lit(None).cast("double"))
    heard = cast.groupBy(key).agg(F.count_distinct("source").alias("heard"))
    best = by.groupBy(key).agg(F.max(F.struct("support", F.coalesce("score", F.lit(-1.0)).alias("score"), "category")).alias("b"))
    return best.join(heard, key).select(key, F.col("b.category").alias("home"), F.col("b.support").alias("support"), ((F.col("heard") >= sources) & (F.col("b.support") < 2)).alias("conflict"))


#: Fixed values of the fallback by sound: the least cosine to an anchor, and how far the runner-up must be behind.
ANCHOR_MIN, ANCHOR_MARGIN = 0.30, 0.02


def nearest_anchor(items: DataFrame, anchors: DataFrame, vector: str, key: str, least: float = ANCHOR_MIN, margin: float = ANCHOR_MARGIN, prefer: dict[str, str] | None = None, close: float = 0.0) -> DataFrame:
    """(key, category, score, home) of anchors (category, anchor, anti): the nearest anchor, and the home if it is clear.

    Clear: above the least by the margin, ahead of the runner-up by the margin, and ahead of its own anti-anchor by
    the margin. `prefer` names a category that wins over another where it runs up within `close`. Anchors are one row
    for each category; all travel to every task, as categories are named by the configuration.
    """
    table = anchors.agg(F.collect_list(F.struct("category", "anchor", "anti")).alias("_all"))
    scored = F.transform("_all", lambda a: F.struct(V.dot(F.col(vector), a["anchor"]).alias("s"), a["category"].alias("c"), V.dot(F.col(vector), a["anti"]).alias("n")))
    rows = items.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(table)).select(key, F.reverse(F.array_sort(scored)).alias("_s"))
    first, second = F.col("_s")[0], F.try_element_at("_s", F.lit(2))
    ahead = first["s"] - F.coalesce(second["s"], F.lit(-1.0))
    clear = (first["s"] >= least + margin) & (ahead >= margin) & F.coalesce(first["s"] - first["n"] >= margin, F.lit(True))
    home = F.when(clear, first["c"])
    for loud, true in (prefer or {}).items():
        home = F.when((first["c"] == loud) & (second["c"] == true) & (ahead < close) & (second["s"] >= least + margin), true).otherwise(home)
    return rows.select(key, first["c"].alias("category"), first["s"].alias("score"), home.alias("home"))


def layout(paths: DataFrame, path: str, types: str, flat_share: float = 0.5, types_share: float = 0.6, umbrella_share: float = 0.8, least_packs: int = 4) -> DataFrame:
    """(layout, umbrellas, files): how a library is laid out, by the shares of its files in top folders; one row.

    flat: half of the files lie in no folder; types: three fifths of the rest in folders named for a type; umbrella:
    four fifths under at most two folders that hold several packs; packs otherwise, also without files.
    """
    parts = paths.where(F.col(path).isNotNull()).select(F.filter(F.split(path, "/"), lambda x: x != "").alias("p"))
    rows = parts.select(F.when(F.size("p") > 1, F.col("p")[0]).alias("top"), F.when(F.size("p") > 2, F.col("p")[1]).alias("sub"))
    tops = rows.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(~F.lower("sub").rlike(types), F.col("sub"))).alias("packs"))
    whole = tops.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(F.col("top").isNull(), F.col("n"))), F.lit(0)).alias("loose"),
        F.coalesce(F.sum(F.when(F.lower("top").rlike(types), F.col("n"))), F.lit(0)).alias("typed"),
    )
    big = tops.where("top IS NOT NULL").orderBy(F.desc("n"), "top").limit(2).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("held"),
        F.coalesce(F.sum(F.when(F.col("packs") >= least_packs, F.col("n"))), F.lit(0)).alias("over"),
        F.array_sort(F.collect_list(F.when(F.col("packs") >= least_packs, F.col("top")))).alias("names"),
    )
    boxed = F.col("files") - F.col("loose")
    kind = (
        F.when(F.col("files") == 0, "packs")
        .when(F.col("loose") >= flat_share * F.col("files"), "flat")
        .when(F.col("typed") >= types_share * boxed, "types")
        .when((F.col("held") >= umbrella_share * boxed) & (F.size("names") > 0) & (F.col("over") >= umbrella_share * boxed), "umbrella")
        .otherwise("packs")
    )
    found = whole.crossJoin(F.broadcast(big)).select(kind.alias("layout"), "names", "files")
    return found.select("layout", F.when(F.col("layout") == "umbrella", F.col("names")).otherwise(F.array().cast("array<string>")).alias("umbrellas"), "files")


#: Rows of a side that meet in one task at most, where more share a key.
BLOCK_ROWS = 4096


def _met(left: DataFrame, right: DataFrame, key: str, on: list[str], own: str) -> DataFrame:
    """left (x) and right (y) joined by `on`; `own` tells the rows of right that are those of left.

    Where over BLOCK_ROWS rows share the columns, their `key` deals them to a grid of blocks: a row stands in one line
    of the grid, so every two still meet once. Few can have so many rows; their sizes are broadcast. The join sorts,
    as a broadcast of a small file would leave all pairs to the few tasks that read it.
    """
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    hot = right.groupBy(*on).agg(blocks(F.count_if(F.expr(own))).alias("_xs"), blocks(F.count(F.lit(1))).alias("_ys")).where("_ys > 1")

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        lines = lambda n: F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
        out = side.join(F.broadcast(hot), on, "left").withColumn(mine, F.pmod(F.xxhash64(key), lines(f"{mine}s")).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), lines(f"{other}s") - 1))).drop("_xs", "_ys")

    return dealt(left, "_x", "_y").alias("x").hint("merge").join(dealt(right, "_y", "_x").alias("y"), [*on, "_x", "_y"])


def edition_pairs(items: DataFrame, key: str, vendor: str, pack: str, folder: str, name: str, seconds: str, tolerance: float = 0.05) -> DataFrame:
    """(a, b) of items that are one recording twice: one distinctive name of one vendor, lengths alike where both are known.

    In one pack the folders must be the same too; across packs the name needs two words. Names meet by an equi-join,
    those of one word with their folder, and lengths by steps: on a logarithmic scale a step is a little wider than the
    tolerance, so lengths that are alike lie in one step or in two that adjoin. Unknown lengths meet all others.
    """
    tell = items.where(F.col(name).rlike("[0-9]") | (F.size(F.split(name, " ")) >= 2))
    words = F.size(F.filter(F.split(name, " "), lambda w: ~w.rlike("^[0-9]+$")))
    long, step = F.col(seconds).cast("double"), F.lit(0).cast("long")  # one step for all, if the tolerance is no share
    if 0 <= tolerance <= 0.9:
        step = F.floor(F.log(F.greatest(long, F.lit(1e-300))) / (1.001 * max(-math.log1p(-tolerance), 1e-6)))
    step = F.when(F.abs(long) < float("inf"), step)  # null for null, NaN and infinity
    rows = tell.select(*(F.col(c).alias(x) for c, x in ((key, "k"), (vendor, "v"), (name, "n"), (pack, "p"), (folder, "f"), (seconds, "s"))), (words >= 2).alias("far"), step.alias("step"))
    rows = rows.where("v IS NOT NULL AND (far OR p IS NOT NULL AND f IS NOT NULL)")
    at = lambda step: F.struct(F.expr("IF(far, NULL, p) AS p"), F.expr("IF(far, NULL, f) AS f"), F.col(step).alias("step"))  # noqa: E731  nulls in structs are equal
    steps = F.when(F.col("step").isNull(), F.array("step")).otherwise(F.array("step", F.col("step") + 1, F.lit(None)))
    left, right = rows.withColumn("at", at("step")), rows.withColumn("to", F.explode(steps)).withColumn("at", at("to"))
    met = _met(left, right, "k", ["v", "n", "at"], "step <=> to")
    once = F.when(F.col("x.step").eqNullSafe(F.col("y.step")), F.col("x.k") < F.col("y.k")).otherwise(F.col("x.k") != F.col("y.k"))
    alike = F.coalesce(F.abs(F.col("x.s") - F.col("y.s")) <= tolerance * F.greatest("x.s", "y.s"), F.lit(True))
    same = F.when(F.col("x.p") == F.col("y.p"), F.col("x.f") == F.col("y.f")).otherwise(F.col("x.far"))
    return met.where(once & alike & same).select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"))


def number_sets(items: DataFrame, group: str, number: str, root: str, tolerance: float = 0.5, least: int = 3, majority: float = 2 / 3) -> DataFrame:
    """(group, offset) of groups whose bare numbers are notes: root less number agrees over enough numbers.

    One reading a number (its median root); the offset that most numbers share within the tolerance must be shared by
    `least` of them, and, octaves aside, by a majority. Items without a root say nothing.
    """
    per = items.where(F.col(root).isNotNull() & F.col(number).between(0, 127)).groupBy(group, number).agg((F.median(root) - F.col(number)).alias("off"))
    pairs = per.alias("x").join(per.alias("y"), F.col(f"x.{group}") == F.col(f"y.{group}"))
    near = F.abs(F.col("x.off") - F.col("y.off")) <= tolerance
    circle = F.pmod(F.col("x.off") - F.col("y.off") + 6, F.lit(12)) - 6
    keys = [F.col(f"x.{group}").alias("_g"), F.col(f"x.{number}").alias("_number"), F.col("x.off").alias("_off")]
    votes = pairs.groupBy(*keys).agg(F.count_if(near).alias("_exact"), F.count_if(F.abs(circle) <= tolerance).alias("_agree"), F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy("_g").agg(F.max(F.struct("_exact", (-F.col("_off")).alias("o"), "_agree", "_n")).alias("b"))
    return best.where((F.col("b._exact") >= least) & (F.col("b._agree") >= majority * F.col("b._n"))).select(F.col("_g").alias(group), (-F.col("b.o")).alias("offset"))


def review_queue(entries: DataFrame, key: str, category: str, family: str, buckets: list[tuple[str, float, DataFrame]], n: int, per_category: int, per_family: int, seed: int = 0) -> DataFrame:
    """(key, bucket, place): what to review next.

    Each bucket (name, share of n, frame of key and order) gives its best rows up to its quota, an item counts in the
    first bucket that names it, and what is left of n is drawn by a seeded hash (12 digits of an MD5). Categories and families are capped
    over the whole queue, in its order. Only the first rows of each bucket, by family and category, reach the last
    sort: per_category rows of each category.
    """
    quota = {name: round(n * share) for name, share, _ in buckets}
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double")
    ranked = None
    for at, (name, _, rows) in enumerate(buckets):
        part = rows.select(key, F.lit(at).alias("_b"), F.lit(name).alias("bucket"), F.col("order").cast("double").alias("_o"))
        ranked = part if ranked is None else ranked.unionByName(part)
    spare = entries.select(key, F.lit(len(buckets)).alias("_b"), F.lit("random").alias("bucket"), drawn.alias("_o"))
    ranked = spare if ranked is None else ranked.unionByName(spare)
    first = ranked.groupBy(key).agg(F.min(F.struct("_b", "_o", "bucket")).alias("f")).select(key, "f.*").join(entries.select(key, category, family), key)
    for group, cap in (([category, family], per_family), ([category], per_category)):
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_b", "_o", key))).where(F.col("_r") <= cap).drop("_r")
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)))
    limit = F.coalesce(*(F.when(F.col("bucket") == name, q) for name, q in quota.items()), F.lit(n)) if quota else F.lit(n)
    return first.where(F.col("_r") <= limit).orderBy("_b", "_o", key).limit(n).select(key, "bucket", F.col("_r").cast("long").alias("place"))
