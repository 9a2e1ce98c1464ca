"""Traces: aligning, slicing and pooling series (series, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import ranged


def interpolated(traces: DataFrame, grid: DataFrame) -> DataFrame:
    """(series, t, value) on the grid (series, t), linear between the samples around each grid time, null beyond the ends.

    Samples and grid are one order over all series, cut into ranges; the neighbours are the last and next samples in it, carried
    over the cuts. So a long series is many tasks, and each row is looked at twice.
    """
    samples = traces.groupBy("series", "t").agg(F.avg("value").alias("value"))
    marks = grid.select("series", "t").distinct().withColumns({"value": F.lit(None).cast("double"), "wanted": F.lit(True)})
    both = samples.withColumn("wanted", F.lit(False)).unionByName(marks)
    base = ranged(both, [F.col("series"), F.col("t"), F.col("value").isNull()])
    held = F.when(F.col("value").isNotNull(), F.struct("series", "t", "value"))
    upto = (W.unboundedPreceding, 0)
    before = F.last(held, ignorenulls=True).over(W.partitionBy("_part").orderBy("_id").rowsBetween(*upto))
    after = F.last(held, ignorenulls=True).over(W.partitionBy("_part").orderBy(F.col("_id").desc()).rowsBetween(*upto))
    place = F.when(F.col("value").isNotNull(), F.col("_id"))
    ends = base.groupBy("_part").agg(F.max_by(held, place).alias("_last"), F.min_by(held, place).alias("_first"))
    parts = W.orderBy("_part")  # a row a part
    ends = ends.select(
        "_part", F.last("_last", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("_in"),
        F.first("_first", ignorenulls=True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("_out"),
    )
    out = base.withColumns({"_a": before, "_b": after}).where("wanted").join(F.broadcast(ends), "_part")
    a, b = F.coalesce("_a", "_in"), F.coalesce("_b", "_out")
    # Marks follow the sample of their own time, so a sample at the mark is before it.
    out = out.withColumns({"a": F.when(a["series"].eqNullSafe(F.col("series")), a), "b": F.when(b["series"].eqNullSafe(F.col("series")), b)})
    share = F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
    value = F.when(F.col("a.t") == F.col("t"), F.col("a.value")).when(F.col("b.t") == F.col("t"), F.col("b.value")).otherwise(F.col("a.value") + share * (F.col("b.value") - F.col("a.value")))
    return out.select("series", "t", value.alias("value"))


def pooled(traces: DataFrame, step: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """The mean of each stretch of step, within a window."""
    held = traces
    if start is not None:
        held = held.where(F.col("t") >= start)
    if end is not None:
        held = held.where(F.col("t") < end)
    return held.groupBy("series", (F.floor(F.col("t") / step) * step).alias("t")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
