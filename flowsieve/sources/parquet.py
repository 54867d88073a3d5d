"""Parquet datasets: read, append, overwrite, and rewrite to a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A dataset read into at least as many partitions as there are cores.

    Only a dataset of fewer splits than cores is redistributed, for work that is heavy per row or
    goes over the rows many times; a large dataset keeps its splits and is not shuffled.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append_parquet(df: DataFrame, path: str) -> None:
    """Add the rows to a dataset. Running it twice adds them twice; see `write_version`."""
    df.write.mode("append").parquet(path)


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a dataset derived from an older version of itself to a new place and return it.

    An existing version is never replaced, so the input stays whole if the write fails half way;
    the rerun takes a new version name.
    """
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def written_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written dataset, read again; the counts come from the file footers."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
