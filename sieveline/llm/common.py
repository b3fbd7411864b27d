"""Shared helpers: the shared folder, materialised tables, Arrow text access and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, a temporary one if all runs in one JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there goes when the driver's JVM ends."""
    top = f"{shared_dir(spark)}/sieveline/{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, top)
    fs.deleteOnExit(p)
    return f"{top}/{name}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


#: Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions in here drop the shuffle files they took; the files they write are all that is needed from then on."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    with cleaned(df.sparkSession):
        df.write.mode(mode).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def numbered(rows: DataFrame, key: str, *ties: str) -> tuple[DataFrame, bool]:
    """rows with `_row` (long), which no two rows share, and whether it is the key itself: it is unique and not null.

    Otherwise rows are sorted by key (nulls first) and ties across all partitions, numbered in that order and written,
    so that a second reading finds the same numbers. Rows equal in all of these columns are numbered in any order.
    """
    seen = rows.groupBy(F.col(key).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if seen.where("n > 1 OR k IS NULL").isEmpty():
        return rows.withColumn("_row", F.col(key).cast("long")), True
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    dealt = rows.repartitionByRange(parts, order[0], F.xxhash64(*ties).asc_nulls_first()) if ties else rows.repartitionByRange(parts, order[0])
    inner = [order[0], F.xxhash64(*ties).asc_nulls_first(), *order[1:]] if ties else order
    return materialize(dealt.sortWithinPartitions(*inner).withColumn("_row", F.monotonically_increasing_id()), "numbered"), False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; one longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 (fixed public constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 odd pseudo-random 64-bit values."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class Powers:
    """b^i and b^-i modulo 2^64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                a = np.full(n, b, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]
