"""Op 3: approximate nearest neighbours by an inverted multi-index.

Vectors are brought to unit length and cut into two halves; each half has CENTROIDS centroids, fitted on at most
SAMPLE rows (the least hashes of vec_id). An entry lies in the cell of its pair of nearest centroids. A query walks
the pairs by summed distance, least first, with a heap, until the cells hold SHARE of all entries and K others at least, and all entries of
those cells are ranked by the exact cosine in double precision.

Cells with the same first centroid meet in one block, split by salts into at most BLOCK entries, and queries come in
blocks of at most BLOCK too; each pair of blocks returns the best K of each query, so no block grows with the data or
with copies of a vector. SHARE is a share of entries, as these vectors have little structure: recall, not speed, sets
it. Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.
Rows with a repeated or null vec_id are entries, and queries, of their own. Ties go to the smaller vec_id. Empty tables, or no query, give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

CENTROIDS, SAMPLE, SHARE, BLOCK, ROUNDS = 64, 8192, 0.5, 8192, 12


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced distinct rows."""
    rows = np.unique(x, axis=0)
    c = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    c = np.unique(c, axis=0)
    for _ in range(ROUNDS):
        at = distances(x, c).argmin(axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def halves(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = first.shape[1]
    return distances(x[:, :cut], first), distances(x[:, cut:], second)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: float) -> np.ndarray:
    """Cells visited, as a boolean table: pairs in the order of a[i] + b[j], until they hold `want` entries."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    seen = np.zeros(counts.shape, bool)
    heap, pushed, got = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, 0
    while heap and got < want:
        _, x, y = heapq.heappop(heap)
        seen[i[x], j[y]] = True
        got += counts[i[x], j[y]]
        for nx, ny in ((x + 1, y), (x, y + 1)):
            if nx < len(i) and ny < len(j) and (nx, ny) not in pushed:
                pushed.add((nx, ny))
                heapq.heappush(heap, (a[i[nx]] + b[j[ny]], nx, ny))
    return seen


def best(q_ids: np.ndarray, q: np.ndarray, may: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of each query among the allowed entries; ties by id. Scores are row sums, equal for equal vectors."""
    out = []
    if not len(ids):
        return out
    norm = np.sqrt((x * x).sum(axis=1))
    rough = (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ (x / norm[:, None]).T
    for n, qid in enumerate(q_ids):
        ok = np.flatnonzero(may[n] & (ids != qid))
        if not len(ok):
            continue
        r = rough[n, ok]
        if len(ok) > k:
            ok = ok[r >= np.partition(r, len(r) - k)[len(r) - k] - 1e-9]
        score = (x[ok] * q[n]).sum(axis=1) / (norm[ok] * np.sqrt((q[n] * q[n]).sum()))
        for i in np.lexsort((ids[ok], -score))[:k]:
            out.append((int(qid), int(ids[ok[i]]), float(score[i])))
    return out


def nearest(entries: DataFrame, is_query, k: int = 5, share: float = SHARE) -> DataFrame:
    """entries (vec_id, embedding) -> query_id, rank, vec_id, score for the rows that `is_query` (a Column) picks."""
    spark = entries.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = entries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows, plain = C.numbered(rows, "vec_id", "v")
    ids = rows.select("_row", F.col("vec_id").alias("id"))
    rows = rows.select(F.col("_row").alias("vec_id"), "v", "q")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.col("v").isNotNull() & sound)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None or usual[0] < 2:
        return nothing
    rows = rows.where(F.size("v") == usual[0])
    drawn = np.array([r[0] for r in rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).select("v").collect()])
    cut = usual[0] // 2
    pair = [fitted(h, CENTROIDS) for h in (unit(drawn)[:, :cut], unit(drawn)[:, cut:])]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = halves(unit(matrix(batch.column(1))), *pair)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(axis=1), pa.int32()), pa.array(b.argmin(axis=1), pa.int32())], names=["vec_id", "v", "q", "a", "b"])

    index = C.materialize(rows.mapInArrow(assign, "vec_id long, v array<double>, q boolean, a int, b int"), "index")
    counts = np.zeros((len(pair[0]), len(pair[1])), np.int64)
    for a, b, n in index.groupBy("a", "b").count().collect():  # at most CENTROIDS^2 rows
        counts[a, b] = n
    total, asked = int(counts.sum()), index.where("q").count()
    if not asked:
        return nothing
    salts = np.maximum(1, -(-counts.sum(axis=1) // BLOCK))
    lots = max(1, -(-asked // BLOCK))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            da, db = halves(unit(matrix(batch.column(1))), *pair)
            at, block, masks = [], [], []
            for n in range(len(batch)):
                seen = walk(da[n], db[n], counts, max(share * total, k + 1))  # the query itself is one of them
                for a in np.flatnonzero(seen.any(axis=1)):
                    at.append(n)
                    block.append(a)
                    masks.append(np.packbits(seen[a]).tobytes())
            ids, v = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), v.take(pa.array(at)), pa.array(block, pa.int32()), pa.array(masks, pa.binary())], names=["query_id", "qv", "a", "mask"])

    of = F.element_at(F.array(*(F.lit(int(s)) for s in salts)), F.col("a") + 1)
    routed = index.where("q").select("vec_id", "v").mapInArrow(route, "query_id long, qv array<double>, a int, mask binary")
    asks = routed.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (of - 1).cast("long"))))
    held = index.select("vec_id", "v", "a", "b").withColumn("salt", F.pmod(F.xxhash64("vec_id"), of)).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    asks, held = (x.withColumn("key", F.xxhash64("a", "salt", "lot")) for x in (asks, held))

    hit = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return hit.empty_table()
        width = len(pair[1])
        may = np.unpackbits(np.frombuffer(b"".join(left.column("mask").to_pylist()), np.uint8).reshape(len(left), -1), axis=1)[:, :width].astype(bool)
        right = right.combine_chunks()
        x, ids, b = matrix(right.column("v").combine_chunks()), right.column("vec_id").to_numpy(), right.column("b").to_numpy()
        q, q_ids = matrix(left.column("qv").combine_chunks()), left.column("query_id").to_numpy()
        rows = []
        for lo in range(0, len(q), 512):
            rows += best(q_ids[lo : lo + 512], q[lo : lo + 512], may[lo : lo + 512][:, b], ids, x, k)
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(hit)], schema=hit)

    hits = asks.groupBy("key").cogroup(held.groupBy("key")).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if plain:
        return found
    found = found.join(ids, F.col("query_id") == F.col("_row")).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
    return found.join(ids, F.col("vec_id") == F.col("_row")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
