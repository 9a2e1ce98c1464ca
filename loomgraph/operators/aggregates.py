"""Grouping, pivoting, matrices in long form (row, col, value) and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank_as_null, is_text_type
from loomgraph.functions.lineage import checkpointed, percentiles

AGGREGATES = ("sum", "mean", "min", "max", "count", "countDistinct", "join")
SEPARATOR = "; "
#: A pivot with more columns or cells than these is refused before it is built.
MOST_COLUMNS, MOST_CELLS = 2_000, 64_000_000


def aggregate(agg: str, column: str, text: bool = False, order: Column | None = None) -> Column:
    """Nothing sums to 0 and has no mean, least or greatest. join lists distinct non-blank values in order of first appearance."""
    c = F.col(column)
    if agg == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if agg == "mean":
        return F.avg(c)
    if agg == "min":
        return F.min(c)
    if agg == "max":
        return F.max(c)
    if agg == "countDistinct":
        return F.count_distinct(c)
    if agg == "join":
        cell = blank_as_null(c.cast("string"))
        if order is None:
            rows = F.array_sort(F.collect_set(cell))
        else:
            found = F.array_sort(F.collect_list(F.when(cell.isNotNull(), F.struct(order.alias("at"), cell.alias("v")))))
            rows = F.array_distinct(F.transform(found, lambda x: x["v"]))
        return F.when(F.size(rows) > 0, F.array_join(rows, SEPARATOR))
    raise ValueError(f"no such aggregate: {agg}")


def group_by(df: DataFrame, by: list[str], agg: str = "count", values: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """by, n and, but for count, <agg>_<column> for each of values. Null is a group of its own."""
    columns = [] if agg == "count" else list(dict.fromkeys(values or []))
    outs = [aggregate(agg, c, order=order).alias(f"{agg}_{c}") for c in columns]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *outs)


def pivot(df: DataFrame, rows: str, columns: str, agg: str = "sum", value: str | None = None) -> DataFrame:
    """One row a label of rows, one column a label of columns, cells that nothing falls into 0.

    The labels of columns are found first: their number is checked before it can build a plan that is too wide.
    """
    if rows == columns:
        raise ValueError("rows and columns are the same column")
    wide = df.select(columns).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(wide) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    tall = df.agg(F.approx_count_distinct(rows)).first()[0]
    if tall * len(wide) > MOST_CELLS:
        raise ValueError(f"about {tall * len(wide)} cells, over {MOST_CELLS}")
    labels = sorted(str(r[0]) for r in wide if r[0] is not None)
    cell = F.count("*") if agg == "count" else aggregate(agg, value)
    grouped = df.groupBy(F.col(rows).cast("string").alias(rows)).pivot(columns, labels).agg(cell)
    return grouped.select(rows, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def pivot_long(df: DataFrame, rows: str, columns: str, agg: str, value: str | None = None) -> DataFrame:
    """The pivot as (row, col, value), without cells that nothing falls into: any number of columns."""
    cell = F.count("*") if agg == "count" else aggregate(agg, value)
    return df.groupBy(F.col(rows).cast("string").alias("row"), F.col(columns).cast("string").alias("col")).agg(cell.cast("double").alias("value"))


STATISTICS = {
    "n": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "sd": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def reduce_matrix(matrix: DataFrame, axis: str = "rows", stats: tuple[str, ...] = tuple(STATISTICS), prefix: str = "", exclude_diagonal: bool = False) -> DataFrame:
    """Statistics of each row or column over its finite cells."""
    line = "row" if axis == "rows" else "col"
    cells = matrix.where("row <> col") if exclude_diagonal else matrix
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    held = cells.select(F.col(line).alias("label"), finite.alias("v"))
    return held.groupBy("label").agg(*[STATISTICS[s](F.col("v")).alias(prefix + s) for s in stats])


def normalize(matrix: DataFrame, mode: str) -> DataFrame:
    """row and column divide by the line's total, max by the greatest magnitude of all, log is log10(1 + x). A line of zeros stays
    one; another line whose total isn't positive has no shares."""
    v = F.col("value")
    if mode == "none":
        return matrix
    if mode == "log":
        return matrix.withColumn("value", F.log1p(v) / F.log(F.lit(10.0)))
    if mode == "max":
        top = matrix.agg(F.max(F.abs(v)).alias("_top"))
        return matrix.join(F.broadcast(top), how="cross").withColumn("value", F.when(F.col("_top") > 0, v / F.col("_top")).otherwise(v)).drop("_top")  # one row
    # Totals are summed before they are moved, so no task holds a line.
    line = "row" if mode == "row" else "col"
    totals = matrix.groupBy(F.col(line).alias("_line")).agg(F.sum(v).alias("_total"), F.max(F.abs(v)).alias("_most"))
    share = F.when(F.col("_most") == 0, F.lit(0.0)).when(F.col("_total") > 0, v / F.col("_total")).otherwise(F.lit(float("nan")))
    return matrix.join(totals, matrix[line].eqNullSafe(totals["_line"])).withColumn("value", share).select(matrix.columns)


def describe(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """A row a column: dtype, non_nulls, nulls, non_zero, unique and, for numbers other than the id, min, quartiles, max and mean.

    Sums take one pass. Each column's values are counted by value, combined before they are moved; unique and
    the quartiles come from these counts. Blank text counts as missing.
    """
    aggs, values = [], []
    for f in df.schema:
        text = is_text_type(f.dataType)
        cell = blank_as_null(F.col(f"`{f.name}`")) if text else F.col(f"`{f.name}`")
        measured = f.dataType.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint") and f.name != id_column
        number = cell.cast("double")
        null = F.lit(None).cast("double")
        stats = [F.min(number), F.max(number), F.avg(number)] if measured else [null] * 3
        zero = F.count(F.when(number != 0, 1)) if measured else F.lit(None).cast("long")
        aggs.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count(cell).alias("non_nulls"), (F.count("*") - F.count(cell)).alias("nulls"),
                zero.alias("non_zero"), *[s.alias(n) for s, n in zip(stats, ("min", "max", "mean"))],
            ).alias(f"c{len(aggs)}")
        )
        key = cell.cast("string") if not measured else F.lit(None).cast("string")
        values.append(F.struct(F.lit(f.name).alias("column"), key.alias("key"), (number if measured else null).alias("number")))
    one = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])).alias("r")).select("r.*")
    long = df.select(F.explode(F.array(*values)).alias("r")).select("r.*").where("key is not null or number is not null")
    counts = checkpointed(long.groupBy("column", "key", "number").agg(F.count("*").alias("n")))
    unique = counts.groupBy("column").agg(F.count("*").alias("unique"))
    # Repeated values stand once in counts, so each is weighted by its count.
    quarters = percentiles(counts.where("number is not null"), "number", [0.25, 0.5, 0.75], ["column"], weight="n").drop("n")
    out = one.join(unique, "column", "left").join(quarters, "column", "left")
    q = [F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))]
    return out.select("column", "dtype", "non_nulls", "nulls", "non_zero", F.coalesce("unique", F.lit(0)).alias("unique"), "min", *q, "max", "mean")


def adjacency(edges: DataFrame, sources: DataFrame, targets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(row, col, value): summed weight from each source to each target that it reaches; groups (id, label) sums by label."""
    kept = edges.join(sources.select(F.col("id").alias("pre")).distinct(), "pre", "left_semi").join(targets.select(F.col("id").alias("post")).distinct(), "post", "left_semi")
    if groups is not None:
        for end in ("pre", "post"):
            kept = kept.join(groups.select(F.col("id").alias(end), F.col("label").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", F.col(end).cast("string"))).drop(f"_{end}")
    return kept.groupBy(F.col("pre").cast("string").alias("row"), F.col("post").cast("string").alias("col")).agg(F.sum("weight").alias("value"))


def region_connectivity(edges: DataFrame, pre_region: str, post_region: str, measure: str = "weight") -> DataFrame:
    cell = F.sum("weight") if measure == "weight" else F.count("*")
    return edges.groupBy(F.col(pre_region).alias("row"), F.col(post_region).alias("col")).agg(cell.alias("value"))


def completeness(rows: DataFrame, region: str, traced: Column, amount: str) -> DataFrame:
    """A row a region: the amount in traced rows, in all, and their ratio."""
    sums = rows.groupBy(region).agg(F.coalesce(F.sum(F.when(traced, F.col(amount))), F.lit(0)).alias("traced"), F.sum(amount).alias("total"))
    return sums.withColumn("ratio", F.try_divide("traced", "total"))


def top_per_group(df: DataFrame, group: list[str], value: str, k: int, ties: tuple[str, ...]) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.col(value).desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def profile(edges: DataFrame, types: DataFrame, k: int) -> DataFrame:
    """(id, partner_type, weight, partners, share, rank): each id's k strongest partner types."""
    typed = edges.join(types.select(F.col("id").alias("post"), "label"), "post", "left")
    sums = typed.groupBy(F.col("pre").alias("id"), F.coalesce("label", F.lit("(none)")).alias("partner_type")).agg(F.sum("weight").alias("weight"), F.count_distinct("post").alias("partners"))
    sums = sums.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy("id")))
    return top_per_group(sums, ["id"], "weight", k, ("partner_type",))


def summary_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, label, n): how many rows have each label of each of columns, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("label")) for c in columns])).alias("r"))
    return long.groupBy("r.attribute", "r.label").agg(F.count("*").alias("n"))
