"""Partitioning guards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster's cores when it is read from fewer
    files than there are cores (a small file with one row group is one
    task), so heavy per-row work (tokenising, chunking) runs on every core.

    The decision uses the input file list, which needs no job; on a cluster
    reading many files nothing is shuffled."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < target:
        return df.repartition(target)
    return df


@contextmanager
def dealt_to(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What is run inside shuffles to at least so many partitions, so that the
    share of one task does not grow with the input; adaptive execution joins
    small ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), partitions)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
