"""Helpers that the operators of this subpackage share.

Intermediate tables are Parquet files in the shared folder that the cluster names in
``spark.checkpoint.dir``: they cut lineage, survive lost executors and can be read by
every executor.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are what lies between these white-space characters, and nothing else ends them.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}
#: Where the tables that stored() wrote lie.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df as written once to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables from which everything that is wanted has been written elsewhere."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: What operators keep in a worker process between tasks: by operator, what lets it go.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, let_go: Callable[[], None]) -> None:
    """Says in a worker that operator keeps something there for its further tasks."""
    _kept[operator] = let_go


def let_go_of_others(operator: str) -> None:
    """Frees what other operators have kept in this worker, which Spark hands from stage to stage."""
    for other in [k for k in _kept if k != operator]:
        _kept.pop(other)()
    give_back()


def give_back() -> None:
    """Returns to the system the memory that this worker has freed: allocators hold on to it otherwise, from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


Batches = Iterator[pa.RecordBatch]


def tidy(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f for mapInArrow, which gives back what a task has freed when it ends."""

    def run(batches: Batches) -> Batches:
        yield from f(batches)
        give_back()

    return run


def whole_groups(batches: Batches, by: list[str]) -> Iterator[pa.Table]:
    """A table for each group of rows that agree in the numbers of by, which lie together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in by]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(bounds, bounds[1:]):
            at = tuple(int(k[a]) for k in keys)
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = at
    if held:
        yield pa.Table.from_batches(held)


#: Rows and bytes of texts that a task hands to its Python worker at once: what is in flight stays small beside an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def in_small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(spark, ...) with BATCH set in its session, which plans read when they run."""

    @wraps(f)
    def run(spark: SparkSession, *rest) -> DataFrame:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        return f(spark, *rest)

    return run


#: Bits of the filter that tells rows that are surely not among others.
FILTER_BITS = 1 << 23


def likely_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key may be among ids (key): all that are and, the more ids there are, some that aren't.

    The filter has FILTER_BITS bits in at most FILTER_BITS / 64 rows, whatever the tables, so it can be broadcast.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("__bits"))
    held = df.withColumn("__at", bit).join(F.broadcast(words), F.shiftright("__at", 6) == F.col("__word"))
    return held.where(F.expr("shiftright(__bits, cast(__at % 64 as int)) & 1L") == 1).select(df.columns)


def in_order(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """df in global order of keys, stored, with ``part`` and ``part_row``: rows ascend with (part, part_row)."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ranged.withColumns(
        {
            "part": F.spark_partition_id(),
            "part_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    return stored(numbered, label)


def part_starts(df: DataFrame, part: str, amount: Column) -> DataFrame:
    """(part, part_start): the sum of amount over all smaller parts. One row a part, so the window stays small."""
    sums = df.groupBy(part).agg(F.sum(amount).alias("part_sum"))
    before = F.sum("part_sum").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    return sums.select(part, F.coalesce(before, F.lit(0)).alias("part_start"))


def least_hashed(df: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """The k rows of df whose seeded hash of keys is least, by hash and keys.

    Rows that cannot be among them are left out before anything is sorted, so a task hands on a few rows and not k.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys, F.lit(seed)))
    n = df.count()
    if n > 4 * k:
        # Of n even draws about 2 k lie below this bound; with fewer than k, all rows are sorted after all.
        bound = -(1 << 63) + int((1 << 64) * 2 * k / n)
        below = hashed.where(F.col("_hash") < bound)
        if below.count() >= k:
            hashed = below
    return hashed.orderBy("_hash", *keys).limit(k).drop("_hash")


def contents(df: DataFrame, *columns: str) -> tuple:
    """Number of rows, sum and exclusive or of their hashes: equal for equal contents, in one pass."""
    h = F.xxhash64(*columns)
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the least node that can be reached.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to
    the least of its neighbourhood, then its smaller ones. The number of rounds grows with the
    logarithm of the longest chain; each round is two aggregations and two joins on
    nodes, whose hot keys adaptive execution splits. Each round's edges go to the shared folder, where those of a few large components
    take so little room that Spark would broadcast them, however many they are: so joins merge.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, label)
    state = contents(pairs, "a", "b")
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least.hint("merge"), "b").select("a", "b", "m")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        after = stored(small.where("a <> b").distinct(), label)
        forget(pairs)
        pairs, before, state = after, state, contents(after, "a", "b")
        if state == before:
            break
    found = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return found.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
