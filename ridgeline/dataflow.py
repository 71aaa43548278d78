"""Partitioned collections of Python values: imperative work by partition that no relational operator expresses.

For everything else use frames: these collections run Python for each value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark import RDD
from pyspark.sql import SparkSession

from ridgeline.plans.ship import ship

EXECUTORS = ("serial", "threads", "cluster")


class Flow:
    """A collection in partitions. Nothing runs before a ``collect``."""

    def __init__(self, rdd: RDD):
        self.rdd = rdd

    def map(self, f: Callable[[Any], Any]) -> Flow:
        return Flow(self.rdd.map(f, preservesPartitioning=True))

    def flatten(self) -> Flow:
        """Values that are iterables give their elements."""
        return self.flat_map(lambda x: x)

    def flat_map(self, f: Callable[[Any], Iterable[Any]]) -> Flow:
        return Flow(self.rdd.flatMap(f))

    def partition_by(self, n: int, key: Callable[[Any], int]) -> Flow:
        """Each value goes to the partition ``key(value) % n``; values of one partition keep the order of their own old partition."""
        if n < 1:
            raise ValueError("at least one partition is needed")
        return Flow(self.rdd.map(lambda v: (key(v), v)).partitionBy(n, lambda k: k % n).values())

    def map_partitions(self, f: Callable[[Iterator[Any]], Iterable[Any]]) -> Flow:
        return Flow(self.rdd.mapPartitions(f))

    def collect_partitions(self) -> list[list[Any]]:
        """All values on the driver, by partition: for results known to be small."""
        return self.rdd.glom().collect()

    def collect(self) -> list[Any]:
        return self.rdd.collect()

    def num_partitions(self) -> int:
        return self.rdd.getNumPartitions()


def parallelize(spark: SparkSession, data: Sequence[Any], executor: str = "cluster") -> Flow:
    """``serial``: one partition, in order; ``threads`` and ``cluster``: a partition for each task that runs at a time."""
    if executor not in EXECUTORS:
        raise ValueError(f"executor must be one of {EXECUTORS}")
    return parallelize_n(spark, data, 1 if executor == "serial" else spark.sparkContext.defaultParallelism)


def parallelize_n(spark: SparkSession, data: Sequence[Any], n: int) -> Flow:
    if n < 1:
        raise ValueError("at least one partition is needed")
    ship(spark)
    return Flow(spark.sparkContext.parallelize(data, n))
