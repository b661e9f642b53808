"""Reading Parquet tables with enough parallelism for work on long texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repartition a plain file scan only if it has fewer splits than cores.

    A large table already has many more splits than the cluster has cores and
    is left as it is; a small one-file table would otherwise run as one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
