"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


#: Shuffled bytes up to which Spark puts partitions together for one task. Rows of a few numbers and a repeated label shrink to ten bytes on their way and take
#: fifty times that in the task's hash tables, so that Spark's own 64 MB would let a task grow to gigabytes.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")


def in_small_tasks(f: Query) -> Query:
    """f with TASK_BYTES in its session, which plans read when they run, unless the session has a size of its own."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, size = TASK_BYTES
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
        return f(spark, sf_dir)

    return run


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = in_small_tasks(f)
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
