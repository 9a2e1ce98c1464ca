"""The tables behind charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import percentiles, running, same_keys


def drawn(columns: tuple[str, ...] | list[str], seed: int) -> Column:
    """A seeded draw for a row, which any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed))))


OTHER, NONE = "Other", "(none)"
#: Bins at the most, drawn automatically and asked for.
MOST_AUTO, MOST_BINS = 80, 500


def bin_width(df: DataFrame, value: str, bins: int | None = None) -> tuple[float, float, int]:
    """(least value, width, number of bins): fixed, or by Freedman and Diaconis, or by Sturges where the quartiles meet."""
    c = F.col(value).cast("double")
    held = df.where(c.isNotNull() & ~F.isnan(c))
    row = held.agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if not row.n:
        return 0.0, 1.0, 0
    if row.hi == row.lo:
        return row.lo, 1.0, 1
    if bins is None:
        low, high = percentiles(held, value, [0.25, 0.75]).first().q
        spread = high - low
        step = 2 * spread / row.n ** (1 / 3)
        bins = math.ceil((row.hi - row.lo) / step) if step > 0 else math.ceil(math.log2(row.n)) + 1
        bins = min(bins, MOST_AUTO)
    bins = max(1, min(MOST_BINS, bins))
    return row.lo, (row.hi - row.lo) / bins, bins


def histogram(df: DataFrame, value: str, bins: int | None = None, series: str | None = None, log_x: bool = False, normalize: str = "count", cumulative: bool = False) -> DataFrame:
    """([series,] bin, from, to, n [, share]): the last bin holds its upper edge, empty bins are left out."""
    if log_x:
        df = df.where(F.col(value) > 0).withColumn(value, F.log10(value))
    lo, width, n_bins = bin_width(df, value, bins)
    c = F.col(value).cast("double")
    at = F.least(F.floor((c - lo) / width), F.lit(max(n_bins - 1, 0))).cast("int")
    by = [series] if series else []
    counts = df.where(c.isNotNull() & ~F.isnan(c)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    out = counts.withColumns({"from": F.lit(lo) + F.col("bin") * width, "to": F.lit(lo) + (F.col("bin") + 1) * width})
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # at most MOST_BINS rows a series
    if cumulative:
        out = out.withColumn("n", F.sum("n").over(group.orderBy("bin")))
    total = F.sum("n").over(group) if not cumulative else F.max("n").over(group)
    if normalize == "percent":
        out = out.withColumn("share", 100 * F.col("n") / total)
    elif normalize == "density":
        out = out.withColumn("share", F.col("n") / (total * width))
    return out


def box_summary(df: DataFrame, value: str, group: str | None = None, whiskers: str = "tukey") -> DataFrame:
    """A row a group: n, mean, quartiles, whiskers (tukey: the furthest values within 1.5 interquartile ranges) and outliers."""
    by = [F.coalesce(F.col(group).cast("string"), F.lit(NONE)).alias("group")] if group else [F.lit("all").alias("group")]
    held = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    q = percentiles(held, "v", [0.05, 0.25, 0.5, 0.75, 0.95], ["group"])
    fences = q.select("group", F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"), F.col("q")[3].alias("q3"), F.col("q")[0].alias("p5"), F.col("q")[4].alias("p95"))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    edges = {"tukey": (F.col("q1") - spread, F.col("q3") + spread), "p5p95": (F.col("p5"), F.col("p95")), "minmax": (F.lit(float("-inf")), F.lit(float("inf")))}[whiskers]
    joined = held.join(fences, "group")
    inside = (F.col("v") >= edges[0]) & (F.col("v") <= edges[1])
    low, high = (F.min(F.when(inside, F.col("v"))), F.max(F.when(inside, F.col("v")))) if whiskers != "p5p95" else (F.first("p5"), F.first("p95"))
    return joined.groupBy("group", "q1", "median", "q3").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), low.alias("low"), high.alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))


def density(df: DataFrame, value: str, group: str, points: int = 64) -> DataFrame:
    """(group, x, density): Gaussian kernel density with Silverman's width on a grid, from binned counts.

    Values are counted into 16 cells a grid step first, so each group joins at most a fixed number of cells with the grid.
    """
    held = df.select(F.col(group).cast("string").alias("group"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = held.groupBy("group").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = stats.join(percentiles(held, "v", [0.25, 0.75], ["group"]).drop("n"), "group")
    spread = F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / 1.349)
    width = 0.9 * F.when(spread > 0, spread).otherwise(F.col("sd")) * F.pow("n", F.lit(-0.2))
    stats = stats.select("group", "n", "lo", "hi", width.alias("h")).where("h > 0")
    cell = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (16 * points))
    cells = held.join(stats, "group").groupBy("group", "n", "lo", "hi", "h", cell.alias("cell")).agg(F.count("*").alias("m"), F.avg("v").alias("c"))
    grid = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / points
    kernel = F.col("m") * F.exp(-0.5 * F.pow((x - F.col("c")) / F.col("h"), 2)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return grid.groupBy("group", "i", x.alias("x")).agg(F.sum(kernel).alias("density")).drop("i")


def rank_share(df: DataFrame, value: str, ties: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = True, flag: Column | None = None) -> DataFrame:
    """rank within by, and the running share of the value, which rows with the flag do not enter. No share where a value is negative or all are 0.

    Rows without a value have no rank and are left out. Groups are stretches of one order over all rows, so none is a task of its own.
    """
    c = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        df = df.where(~F.isnan(c))
    df = df.where(c.isNotNull())
    counted = F.when(~F.coalesce(flag, F.lit(False)), c) if flag is not None else c
    ranked = running(df, [*map(F.col, by), c.desc() if descending else c.asc(), *[F.col(t) for t in ties]], {"_upto": counted})
    own = F.coalesce(counted, F.lit(0))
    totals = ranked.groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]).agg(
        F.sum(counted).alias("_total"), F.min(counted).alias("_least"), F.min("row_at").alias("_first"), F.min_by(F.col("_upto") - own, "row_at").alias("_before")
    )
    placed = ranked.join(totals, same_keys(ranked, totals, list(by))) if by else ranked.crossJoin(F.broadcast(totals))  # one row
    share = F.when((F.col("_least") >= 0) & (F.col("_total") > 0), (F.col("_upto") - F.col("_before")).cast("double") / F.col("_total").cast("double"))
    return placed.select(*df.columns, (F.col("row_at") - F.col("_first") + 1).alias("rank"), share.alias("share"))


def folded(sums: DataFrame, label: str, amount: str, most: int) -> DataFrame:
    """The most - 1 largest labels and Other for the rest, if there are more than most.

    Only the most + 1 largest rows are ranked; the others need no order.
    """
    top = sums.orderBy(F.col(amount).desc(), label).limit(most + 1)
    w = W.partitionBy(F.lit(0))  # most + 1 rows
    ranked = top.withColumns({"_rank": F.row_number().over(w.orderBy(F.col(amount).desc(), label)), "_n": F.count("*").over(w)})
    kept = ranked.where((F.col("_n") <= most) | (F.col("_rank") < most)).select(F.col(label).alias("_kept"))
    named = sums.join(F.broadcast(kept), F.col(label).eqNullSafe(F.col("_kept")), "left")
    return named.groupBy(F.coalesce("_kept", F.lit(OTHER)).alias(label)).agg(F.sum(amount).alias(amount))


def pie(df: DataFrame, category: str, value: str | None = None, most: int = 8) -> DataFrame:
    """(category, amount, share): rows, or the sum of values that aren't negative."""
    held = df if value is None else df.where(F.col(value) >= 0)
    amount = F.count("*") if value is None else F.sum(value)
    sums = held.groupBy(F.coalesce(F.col(category).cast("string"), F.lit(NONE)).alias(category)).agg(amount.alias("amount"))
    out = folded(sums, category, "amount", most)
    return out.withColumn("share", F.try_divide(F.col("amount"), F.sum("amount").over(W.partitionBy(F.lit(0)))))  # at most `most` rows


def bars(df: DataFrame, category: str, value: str, series: str | None = None, most_series: int = 8) -> DataFrame:
    """(category, [series,] total). Series beyond the largest are folded."""
    if series is None:
        return df.groupBy(category).agg(F.sum(value).alias("total"))
    sums = df.groupBy(category, F.coalesce(F.col(series).cast("string"), F.lit(NONE)).alias(series)).agg(F.sum(value).alias("total"))
    by_series = sums.groupBy(series).agg(F.sum("total").alias("_whole"))
    top = by_series.orderBy(F.col("_whole").desc(), series).limit(most_series + 1)
    w = W.partitionBy(F.lit(0))  # most_series + 1 rows
    ranked = top.withColumns({"_rank": F.row_number().over(w.orderBy(F.col("_whole").desc(), series)), "_n": F.count("*").over(w)})
    kept = ranked.where((F.col("_n") <= most_series) | (F.col("_rank") < most_series)).select(series, F.col(series).alias("_name"))
    named = sums.join(F.broadcast(kept), series, "left")
    return named.groupBy(category, F.coalesce("_name", F.lit(OTHER)).alias(series)).agg(F.sum("total").alias("total"))


def trend(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Least-squares line of each group: n, slope, intercept, r."""
    by = [group] if group else []
    held = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return held.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def decimated(df: DataFrame, x: str, y: str, series: str, buckets: int) -> DataFrame:
    """(series, bucket, x_from, y_min, y_max): each line thinned to the extremes of equal stretches of x."""
    held = df.select(series, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"))
    ends = held.groupBy(F.col(series).alias("_series")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))  # a row a series
    at = F.least(F.floor(F.try_divide((F.col("_x") - F.col("_lo")) * buckets, F.col("_hi") - F.col("_lo"))), F.lit(buckets - 1)).cast("int")
    held = held.join(ends, F.col(series).eqNullSafe(F.col("_series"))).withColumn("bucket", F.coalesce(at, F.lit(0)))
    return held.groupBy(series, "bucket").agg(F.min("_x").alias("x_from"), F.min("_y").alias("y_min"), F.max("_y").alias("y_max"))


def sankey(df: DataFrame, layer: str, source: str, target: str, value: str, fold: int) -> DataFrame:
    """(layer, source, target, value): flows summed, each layer's smaller targets folded."""
    sums = df.groupBy(layer, source, target).agg(F.sum(value).alias("value"))
    ends = sums.groupBy(layer, target).agg(F.sum("value").alias("_whole"))
    w = W.partitionBy(layer)
    ranked = ends.withColumns({"_rank": F.row_number().over(w.orderBy(F.col("_whole").desc(), target)), "_n": F.count("*").over(w)})
    name = F.when((F.col("_n") <= fold) | (F.col("_rank") < fold), F.col(target).cast("string")).otherwise(F.lit(OTHER))
    return sums.join(ranked.select(layer, target, name.alias("_name")), [layer, target]).groupBy(layer, source, F.col("_name").alias(target)).agg(F.sum("value").alias("value"))


def laminar_profile(df: DataFrame, depth: str, width: float, series: str | None = None) -> DataFrame:
    by = [series] if series else []
    return df.where(F.col(depth).isNotNull()).groupBy(*by, (F.floor(F.col(depth) / width) * width).alias("from")).agg(F.count("*").alias("n"))


def gallery(df: DataFrame, group: str, per_group: int, seed: int, ids: tuple[str, ...]) -> DataFrame:
    """per_group rows of each group, by the least seeded hash of ids."""
    w = W.partitionBy(group).orderBy(drawn(ids, seed), *ids)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group)
