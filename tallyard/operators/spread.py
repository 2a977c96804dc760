"""Keeping all cores busy where a scan has few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For operators whose cost is CPU and not bytes: a table of one small file is one
    split, and would keep one core busy. Tables with enough splits are left as they
    are, so at scale nothing is shuffled. Rows are placed by hash of ``keys``, which
    makes retries repeat the same partitions.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df
