"""Exact vector operators: top-k, centroids, nearest centroid, pairs over a threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def top_k(items: DataFrame, vector: str, query: list[float], k: int, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """The k largest dot products with a query vector: one pass and a top-k, ties by key."""
    if allowed is not None:
        items = items.join(allowed.select(key), key, "left_semi")
    score = V.dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return items.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def centroids(items: DataFrame, vector: str, group: str) -> DataFrame:
    """(group, n, centroid): the mean vector of each group at length one, by partial sums of each component."""
    parts = items.select(group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    lists = means.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return lists.select(group, "n", V.unit(F.col("mean")).alias("centroid"))


def placed(items: DataFrame, middle: DataFrame, vector: str, group: str, key: str) -> DataFrame:
    """(key, own, other, margin): cosine to the own centroid, the best other group and by how much it is nearer.

    The centroids are one row for each group; their whole table travels to every task only as they are so few.
    """
    table = middle.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c"))).alias("_all"))
    rows = items.crossJoin(F.broadcast(table))
    scored = F.transform("_all", lambda x: F.struct(V.dot(F.col(vector), x["c"]).alias("s"), x["g"].alias("g")))
    rows = rows.withColumn("_s", scored)
    own = F.filter("_s", lambda x: x["g"] == F.col(group))[0]["s"]
    rows = rows.withColumns({"own_score": own, "_best": F.array_max(F.filter("_s", lambda x: x["g"] != F.col(group)))})
    return rows.select(key, group, "own_score", F.col("_best.g").alias("other"), (F.col("_best.s") - F.col("own_score")).alias("margin"))


#: Rows of one side of a block product.
BLOCK_ROWS = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _parted(items: DataFrame, vector: str, key: str, group: str) -> DataFrame:
    """(g, k, v, part, parts): a group's rows dealt to parts of about BLOCK_ROWS, so that no task holds a group."""
    rows = items.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    return rows.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])


def close_pairs(items: DataFrame, vector: str, key: str, block: str, least: float) -> DataFrame:
    """(a, b, score): pairs within a block whose dot product reaches the threshold; a < b.

    Exact: parts of a block meet pairwise as matrix products, and only pairs over the threshold leave a task. Rows
    without a vector or a block are in no pair.
    """
    rows = _parted(items, vector, key, block)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def work(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        part, ids, x = table.column("part").to_numpy(), table.column("k").to_numpy(), _matrix(table.column("v"))
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        i, j = np.nonzero(x[left] @ x[right].T >= least - 1e-9)
        i, j = left[i], right[j]
        once = ids[i] < ids[j] if lo == hi else ids[i] != ids[j]
        i, j = i[once], j[once]
        score = (x[i] * x[j]).sum(axis=1)
        there = score >= least
        a, b = ids[i[there]], ids[j[there]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[there])], schema=PAIRS)

    return met.select("g", "lo", "hi", "part", "k", "v").groupBy("g", "lo", "hi").applyInArrow(work, "a long, b long, score double")


def nearest_in_group(queries: DataFrame, items: DataFrame, vector: str, key: str, group: str, k: int) -> DataFrame:
    """(a, b, place, score): the k rows of a query's group with the largest dot products, ties to the lesser key."""
    held = _parted(items, vector, key, group)
    sizes = held.groupBy("g").agg(F.max("parts").alias("parts"))
    asks = queries.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).join(sizes, "g")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return PAIRS.empty_table()
        q, x, q_ids, ids = _matrix(left.column("v")), _matrix(right.column("v")), left.column("k").to_numpy(), right.column("k").to_numpy()
        out = []
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ x.T
            rough[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
            for n, row in enumerate(rough):
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                near = np.flatnonzero((row >= least - 1e-9) & (row > -np.inf))
                score = (x[near] * q[at + n]).sum(axis=1)
                out += [(int(q_ids[at + n]), int(ids[near[i]]), float(score[i])) for i in np.lexsort((ids[near], -score))[:k]]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(PAIRS)], schema=PAIRS)

    best = asks.select("g", "part", "k", "v").groupBy("g", "part").cogroup(held.select("g", "part", "k", "v").groupBy("g", "part")).applyInArrow(work, "a long, b long, score double")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("a", "b", "place", "score")


def medoids(items: DataFrame, middle: DataFrame, vector: str, group: str, key: str, per_group: int) -> DataFrame:
    """The items nearest to the centroid of their group."""
    near = items.join(middle, group).select(group, key, V.dot(F.col(vector), F.col("centroid")).alias("score"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).where(F.col("place") <= per_group)


def z_scores(rows: DataFrame, names: list[str], over: list[str]) -> DataFrame:
    """Columns z_<name>: deviation in population standard deviations across the rows of a group."""
    w = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(1))
    return rows.withColumns({f"z_{n}": (F.col(n) - F.avg(n).over(w)) / (F.stddev_pop(n).over(w) + 1e-9) for n in names})


def nearest_to_set(items: DataFrame, chosen: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, nearest): the largest cosine to another row of a chosen set, exact, by matrix products of blocks.

    Items and set are dealt to parts of about BLOCK_ROWS each, every part of the one meets every part of the other,
    and the best of each pair of parts is a partial maximum; nothing passes through the driver but two counts. Rows
    without a vector take no part; an item alone with itself has no nearest and is left out.
    """

    def sound(df: DataFrame) -> tuple[DataFrame, int]:
        rows = df.where(F.col(vector).isNotNull() & (V.norm(F.col(vector)) > 0)).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
        return rows, max(1, -(-rows.count() // BLOCK_ROWS))

    (left, m), (right, n) = sound(items), sound(chosen)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = left.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(m))).withColumn("j", every(n))
    right = right.withColumn("j", F.pmod(F.xxhash64("k"), F.lit(n))).withColumn("i", every(m))
    best = pa.schema([(key, pa.int64()), ("nearest", pa.float64())])

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return best.empty_table()
        x, y = _matrix(a.column("v")), _matrix(b.column("v"))
        own, ids = a.column("k").to_numpy(), b.column("k").to_numpy()
        x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
        near = []
        for at in range(0, len(own), 1024):
            score = x[at : at + 1024] @ y.T
            score[own[at : at + 1024, None] == ids[None, :]] = -np.inf
            near.append(score.max(axis=1))
        return pa.table([pa.array(own), pa.array(np.concatenate(near))], schema=best)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(work, f"{key} long, nearest double")
    return found.groupBy(key).agg(F.max("nearest").alias("nearest")).where(F.col("nearest") > F.lit(float("-inf")))
