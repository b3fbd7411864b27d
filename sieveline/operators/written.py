"""Tables written to the folder all executors share: cut lineage that survives a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one if all runs in one JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet and read again."""
    spark = df.sparkSession
    top = f"{shared(spark)}/sieveline/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # goes when the driver's JVM ends
    df.write.parquet(f"{top}/{name}")
    return spark.read.schema(df.schema).parquet(f"{top}/{name}")
