"""Tables that cut lineage, and the library's own tables as append-only logs with a latest view."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder; on one machine below a temporary one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):  # local-cluster has executors of their own
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="folium-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folium/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again, so that a lost executor costs no more than a new read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Steps:
    """The tables of a loop: each step is written like saved(), and the step before it, which nothing reads any more, goes."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.n = spark, scratch(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        path, last = f"{self.base}/{self.n}", f"{self.base}/{self.n - 1}"
        df.write.parquet(path)
        if self.n:
            remove(self.spark, last)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds rows to a log table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order (I12): what a reader of a log table sees."""
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return log.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Writes the latest rows of a log table as a table of its own."""
    latest(spark.read.parquet(path), keys, order).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
