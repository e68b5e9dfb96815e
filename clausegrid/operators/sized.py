"""Broadcasts behind a look at the size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast as they are: a rule set, its concepts, its anchors.
FEW = 1 << 12


def sized(small: DataFrame, most: int = FEW) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``most`` rows, which is looked up now; else as it is, and the planner decides."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def blocks(rows: DataFrame, key: str, size: int = FEW) -> Iterator[DataFrame]:
    """``rows`` in parts of about ``size`` by the hash of ``key``, each marked for broadcast: any number of rows meets a large
    table block by block."""
    n = -(-rows.count() // size)
    for k in range(n):
        yield F.broadcast(rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))


def spread(stored: DataFrame) -> DataFrame:
    """A stored table in as many partitions as there are cores at least: one small file is one task, whatever each row costs."""
    n = stored.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() >= n else stored.repartition(n)
