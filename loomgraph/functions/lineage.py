"""Cutting lineage so that it survives lost executors, and running sums over all rows without one task for them."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode, where every task can read it."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folders.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))


#: Where the states that were written here lie, as long as someone holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def state_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-states/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once, as Parquet, to the shared folder and read from it: columns are pruned and sizes known."""
    spark = df.sparkSession
    path = state_path(spark)
    df.write.parquet(path)
    state = spark.read.schema(df.schema).parquet(path)
    _paths[state] = path
    return state


def measured(df: DataFrame, **numbers: Column) -> tuple[DataFrame, dict]:
    """df checkpointed, and aggregates over its rows, taken while it is written: one job instead of two."""
    seen = Observation()
    state = checkpointed(df.observe(seen, *[c.alias(n) for n, c in numbers.items()]))
    return state, seen.get


def forget(*states: DataFrame) -> None:
    """Deletes written states that nothing lazy reads any longer; frames that were not written here are left alone."""
    for state in states:
        if path := _paths.pop(state, None):
            at = state.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(state.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_clustered(df: DataFrame, keys: list[str], path: str, buckets: int) -> str:
    """Writes df to path in buckets by keys, a file a bucket, sorted; returns the name under which the session's catalog knows it."""
    name = "clustered_" + uuid.uuid4().hex
    placed = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    placed.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def cataloged(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int) -> DataFrame:
    """A bucketed table whose files lie at path, told to this session's catalog."""
    name = "clustered_" + uuid.uuid4().hex
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df written once in buckets by keys and sorted within them: joins and sums on keys read it without moving it.

    There are as many buckets as shuffle partitions, so the other side of a join comes to the buckets. The table is known to this session's
    catalog alone; its files lie in the shared folder like any state.
    """
    spark = df.sparkSession
    path = state_path(spark)
    state = spark.table(write_clustered(df, keys, path, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    _paths[state] = path
    return state


def ranged(df: DataFrame, keys: list[Column], more: dict[str, Column] | None = None) -> DataFrame:
    """df in the order of keys, checkpointed, with _part and _id: rows ascend with _id, and a _part holds a stretch of them.

    The ranges are checkpointed because a second evaluation could cut them elsewhere.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    inside = checkpointed(placed.withColumns({"_id": F.monotonically_increasing_id(), **(more or {})}))
    return inside.withColumn("_part", F.shiftright("_id", 33))


def running(df: DataFrame, keys: list[Column], sums: dict[str, Column] | None = None, name: str = "row_at") -> DataFrame:
    """df with row_at = 0, 1, 2, ... in the order of keys, and for each of sums the sum over all rows up to this one.

    Rows are ranged over partitions, numbered and summed within each, and shifted by what the partitions before hold.
    """
    sums = sums or {}
    inside = ranged(df, keys, {f"_{n}": c for n, c in sums.items()})
    totals = inside.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(f"_{n}").alias(f"_{n}_all") for n in sums])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = totals.select("_part", start("_rows").alias("_at"), *[start(f"_{n}_all").alias(f"_{n}_start") for n in sums])
    out = inside.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    if sums:
        w = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumns({n: F.col(f"_{n}_start") + F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)) for n in sums})
    return out.select(*df.columns, name, *sums)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which null equals null; right has them as _k0, _k1, ..."""
    held = F.lit(True)
    for i, k in enumerate(keys):
        held = held & left[k].eqNullSafe(right[f"_k{i}"])
    return held


#: Distinct values, of all groups together, up to which percentiles rank them in a window instead of over ranges.
FEW_VALUES = 20_000


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, n and q: an array of the exact percentiles of value, by linear interpolation between closest ranks.

    Values are counted before they are moved, and where there are more than FEW_VALUES of them ranks come from sums over ranges, so no task holds a group. Missing values and
    those that are no number do not count; groups without a value have no row. A weight counts a row more than once.
    """
    by = by or []
    held = df.select(*by, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")).where("_v is not null and not isnan(_v)")
    counts = held.groupBy(*by, "_v").agg(F.sum("_w").alias("_n"))
    counts, seen = measured(counts, rows=F.count("*"))
    if seen["rows"] <= FEW_VALUES:
        ranked = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    else:
        ranked = running(counts, [*map(F.col, by), F.col("_v")], {"_upto": F.col("_n")})
    totals = ranked.groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]).agg(F.sum("_n").alias("_all"), F.min(F.col("_upto") - F.col("_n")).alias("_base"))
    placed = ranked.join(totals, same_keys(ranked, totals, by)) if by else ranked.crossJoin(F.broadcast(totals))  # one row
    first, last = F.col("_upto") - F.col("_n") - F.col("_base"), F.col("_upto") - 1 - F.col("_base")
    cells = []
    for p in shares:
        at = F.lit(float(p)) * (F.col("_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        pick = lambda rank: F.max(F.when((first <= rank) & (rank <= last), F.col("_v")))
        cells.append((pick(low), pick(high), F.max(at - low)))
    picked = placed.groupBy(*by).agg(F.max("_all").alias("n"), *[c.alias(f"_{x}{i}") for i, three in enumerate(cells) for c, x in zip(three, "abf")])
    mixed = [F.when(F.col(f"_f{i}") == 0, F.col(f"_a{i}")).otherwise((1 - F.col(f"_f{i}")) * F.col(f"_a{i}") + F.col(f"_f{i}") * F.col(f"_b{i}")) for i in range(len(shares))]
    return picked.where("n > 0").select(*by, "n", F.array(*mixed).alias("q"))
