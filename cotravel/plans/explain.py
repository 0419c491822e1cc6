"""What a plan must not and must have, and how long it takes."""

from __future__ import annotations

import re
import time
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def has_quadratic_join(df: DataFrame) -> bool:
    """A join that compares all pairs: cartesian product or nested loop."""
    return bool(re.search("CartesianProduct|BroadcastNestedLoopJoin", physical(df)))


def shuffles(df: DataFrame) -> int:
    """Exchanges by a key in the plan before it runs."""
    return len(re.findall(r"Exchange (?:hash|range)partitioning", physical(df)))


def columns_read(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)", physical(df))


def timed(df: DataFrame) -> DataFrame:
    """Run a query to its end: one row (seconds, pairs), its time and the number of its rows."""
    began = time.perf_counter()
    n = df.count()
    return df.sparkSession.createDataFrame([(time.perf_counter() - began, n)], "seconds double, pairs long")


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """The table, kept for the queries inside the block and let go after it; what is lost is computed again."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()
