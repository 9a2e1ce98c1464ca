"""Loops as sets: what runs once an element elsewhere runs here for all elements in one plan, told apart by a pass number."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lineage import running

NONE = "(none)"


def passes(df: DataFrame, order: tuple[str, ...], group: str | None = None, batch: int = 1, limit: int | None = None) -> DataFrame:
    """df with ``pass_at``: the number of its element, batch of elements, or group in order of first appearance.

    Blank and missing groups are one, named (none). limit keeps the first passes.
    """
    rows = running(df, [F.col(c) for c in order])
    if group is None:
        out = rows.withColumn("pass_at", F.floor(F.col("row_at") / batch)).drop("row_at")
    else:
        name = F.coalesce(F.when(F.trim(F.col(group).cast("string")) != "", F.col(group).cast("string")), F.lit(NONE))
        named = rows.withColumn("_group", name)
        firsts = named.groupBy("_group").agg(F.min("row_at").alias("_first"))
        numbers = running(firsts, [F.col("_first")], name="pass_at").select("_group", "pass_at")
        out = named.join(numbers, "_group").drop("_group", "row_at")
    return out.where(F.col("pass_at") < limit) if limit is not None else out


def for_each(df: DataFrame, order: tuple[str, ...], body: Callable[[DataFrame], DataFrame], group: str | None = None, batch: int = 1, limit: int | None = None) -> DataFrame:
    """body over df with pass_at, which body must group by where it aggregates: all passes are one job."""
    return body(passes(df, order, group, batch, limit))


def collect(parts: list[DataFrame]) -> DataFrame:
    """The results of several passes, one after another, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ordered_lines(matrix: DataFrame, by: str = "label", axis: str = "row", key: str | None = None) -> DataFrame:
    """(label, place) for the lines of a matrix (row, col, value): by label, by descending total, or by their value on a key line."""
    from loomgraph.functions.columns import natural_key

    other = "col" if axis == "row" else "row"
    if by == "label":
        lines, keys = matrix.select(F.col(axis).alias("label")).distinct(), [natural_key(F.col("label")), F.col("label")]
    elif by == "total":
        lines, keys = matrix.groupBy(F.col(axis).alias("label")).agg(F.sum("value").alias("_v")), [F.col("_v").desc(), F.col("label")]
    else:
        at = F.max(F.when(F.col(other) == key, F.col("value")))
        lines, keys = matrix.groupBy(F.col(axis).alias("label")).agg(at.alias("_v")), [F.col("_v").desc_nulls_last(), F.col("label")]
    return running(lines, keys, name="place").select("label", "place")
