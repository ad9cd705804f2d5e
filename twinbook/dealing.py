"""Dealing rows by a key into as many partitions as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task gets, about: what it sorts or groups at once.
ROWS = 1 << 19


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key``, some ROWS to a partition.

    Their number is counted first: a fixed number of partitions, or one that is
    set by the bytes of well packed rows, lets a task's memory grow with the input.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(parts, key)
