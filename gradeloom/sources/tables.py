"""Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.sources.staging import planner_bytes, split_bytes

# Input of one task where a task keeps something of every row, as counting n-grams does.
TASK_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def too_few_splits(df: DataFrame) -> bool:
    """True when the input files split into fewer tasks than the cluster has slots.

    Ask this of plain scans only: for them it costs planning, no job.
    """
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def task_count(df: DataFrame) -> int:
    """Tasks of at most ``TASK_BYTES`` of a plain scan, and two for every slot.

    No split holds more than the session's ``maxPartitionBytes``; that bounds what the planner
    thinks of frames which are no scan of files.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = min(planner_bytes(df), df.rdd.getNumPartitions() * split_bytes(df.sparkSession))
    return max(2 * slots, -(-size // TASK_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rebalance a scan that would leave slots idle before heavy per-row work; else unchanged."""
    if not too_few_splits(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
