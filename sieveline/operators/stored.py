"""Stored tables that change: provider partitions, upserts, cascades, new columns, migrations and releases.

A table is a folder of Parquet. A rewrite goes to a new version folder, and a small pointer names the current one only
once it is whole, so a job that dies leaves the version before it in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_provider(rows: DataFrame, path: str, partition: str = "provider") -> None:
    """Replace the partitions that `rows` has, and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


class Versioned:
    """A table whose versions are folders; `current` names the one that holds."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        p, fs = self._file("_current")
        if not fs.exists(p):
            return None
        # one line of text
        return self.spark.read.text(f"{self.path}/_current/*.txt").first()[0]

    def exists(self) -> bool:
        return self.version() is not None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version()}")

    def replace(self, rows: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self._point(name)

    def _point(self, name: str) -> None:
        p, fs = self._file("_current/now.txt")
        held, _ = self._file("_current/next.tmp")
        out = fs.create(held, True)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(held, p)

    def upsert(self, changes: DataFrame, version: str) -> None:
        """The latest row of each key by `version`, of the table and a batch of changes."""
        if not self.exists():
            both = changes
        else:
            both = self.read().unionByName(changes, allowMissingColumns=True)
        latest = Window.partitionBy(*self.key).orderBy(F.desc(version))
        self.replace(both.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r"))

    def remove(self, keys: DataFrame) -> None:
        self.replace(self.read().join(keys.select(*self.key).distinct(), self.key, "left_anti"))

    def evolve(self, schema: T.StructType) -> list[str]:
        """Add the columns of a schema that the table has not, as nulls; their names."""
        rows = self.read()
        fresh = [f for f in schema if f.name not in rows.columns]
        if fresh:
            self.replace(rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fresh}))
        return [f.name for f in fresh]


def cascade(keys: DataFrame, children: list[tuple[Versioned, str]], parent: Versioned) -> None:
    """Delete from the children (table, column of the parent's key), then from the parent."""
    for table, column in children:
        table.replace(table.read().join(keys.select(F.col(parent.key[0]).alias(column)).distinct(), column, "left_anti"))
    parent.remove(keys)


def migrate(applied: Versioned, steps: list[tuple[int, Callable[[], None]]]) -> list[int]:
    """Run the numbered steps that the version table has not, in order, each recorded when done."""
    done = {r[0] for r in applied.read().select("version").collect()} if applied.exists() else set()
    ran = []
    for number, step in sorted(steps, key=lambda s: s[0]):
        if number in done:
            continue
        step()
        applied.upsert(applied.spark.range(1).select(F.lit(number).cast("long").alias("version"), F.current_timestamp().alias("applied_at")), "applied_at")
        ran.append(number)
    return ran


def record_release(path: str, version: str, files: DataFrame) -> None:
    """The files of a release as one partition; recording a version again replaces it."""
    replace_provider(files.withColumn("version", F.lit(version)), path, "version")


def merged_manifest(stored: DataFrame, built: DataFrame, category: str) -> DataFrame:
    """Entries of rebuilt categories replace the stored ones; other categories stay."""
    return stored.join(built.select(category).distinct(), category, "left_anti").unionByName(built, allowMissingColumns=True)


def swapped(spark: SparkSession, next_path: str, path: str, before_path: str) -> None:
    """Put what lies at next_path in the place of path, whose folder becomes before_path; may be repeated after a crash.

    Every step is one rename, and each looks at what is there, so a run that died half way goes on where it stopped.
    """
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(next_path)):
        if not fs.exists(at(path)):
            raise FileNotFoundError(next_path)
        return
    if fs.exists(at(path)):
        fs.delete(at(before_path), True)
        fs.rename(at(path), at(before_path))
    fs.rename(at(next_path), at(path))


def embedded(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(digest, text, vector) of the distinct texts, from a table keyed by content that only grows by what it lacks.

    `embed` adds a column `vector` to rows (digest, text); it sees each text once, ever.
    """
    spark = texts.sparkSession
    wanted = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "text").distinct()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    new = wanted.join(spark.read.parquet(path).select("digest"), "digest", "left_anti") if there else wanted
    embed(new).select("digest", "text", "vector").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select("digest"), "digest", "left_semi")
