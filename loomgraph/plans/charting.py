"""Chart tables and traces over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import charts, traces
from loomgraph.plans.registry import Registry, table

R = Registry()

_FD = """
WITH s AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer),
b AS (SELECT lo, hi, least(80, greatest(1, ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))))) AS bins FROM s), w AS (SELECT lo, bins, (hi - lo) / bins AS width FROM b),
c AS (SELECT CAST(least(floor((c_acctbal - lo) / width), bins - 1) AS INTEGER) AS bin, lo, width FROM customer, w)
"""


@R.add(_FD + 'SELECT bin, count(*) AS n, round(any_value(lo + bin * width), 6) AS "from", round(any_value(lo + (bin + 1) * width), 6) AS "to" FROM c GROUP BY bin')
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = charts.histogram(table(spark, sf_dir, "customer"), "c_acctbal")
    return out.withColumns({c: F.round(c, 6) for c in ("from", "to")})


@R.add("""
SELECT event_type, bin, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS BIGINT) AS n FROM
(SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2)
""")
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram(table(spark, sf_dir, "events"), "value", bins=10, series="event_type", cumulative=True).select("event_type", "bin", "n")


@R.add("""
WITH q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT q.*, value AS v, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q ON event_type = g)
SELECT g AS "group", round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, count(*) AS n, round(avg(v), 6) AS mean, min(v) FILTER (inside) AS low, max(v) FILTER (inside) AS high,
  count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY 1
""")
def box_tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.box_summary(table(spark, sf_dir, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "q1", "median", "q3")})


@R.add("""
WITH s AS (SELECT event_type AS g, count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS spread FROM events GROUP BY 1),
h AS (SELECT g, n, lo, hi, 0.9 * CASE WHEN least(sd, spread) > 0 THEN least(sd, spread) ELSE sd END * pow(n, -0.2) AS h FROM s),
c AS (SELECT g, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(h) AS h, count(*) AS m, avg(value) AS c FROM events JOIN h ON event_type = g GROUP BY g, floor((value - lo) / (hi - lo) * 1024)),
x AS (SELECT *, lo + (hi - lo) * i / 64 AS x FROM c, (SELECT unnest(range(0, 65)) AS i))
SELECT g AS "group", round(any_value(x), 8) AS x, round(sum(m * exp(-0.5 * pow((x - c) / h, 2)) / (n * h * sqrt(2 * pi()))), 9) AS density FROM x GROUP BY g, i
""")
def violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = charts.density(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("group", F.round("x", 8).alias("x"), F.round("density", 9).alias("density"))


@R.add("""
SELECT c_custkey, c_nationkey, rank, round(share, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY t DESC, c_custkey) AS rank,
  sum(t) OVER (PARTITION BY c_nationkey ORDER BY t DESC, c_custkey ROWS UNBOUNDED PRECEDING) / sum(t) OVER (PARTITION BY c_nationkey) AS share
FROM (SELECT c_custkey, c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))
""")
def rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("p").cast("double").alias("t"))
    held = sums.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    out = charts.rank_share(held, "t", ("c_custkey",), by=("c_nationkey",))
    return out.select("c_custkey", "c_nationkey", "rank", F.round("share", 9).alias("share"))


@R.add("""
WITH s AS (SELECT p_brand, count(*) AS amount FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, p_brand) AS k FROM s),
f AS (SELECT CASE WHEN k < 8 THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(amount) AS BIGINT) AS amount FROM r GROUP BY 1)
SELECT p_brand, amount, round(amount / sum(amount) OVER (), 9) AS share FROM f
""")
def pie_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.pie(table(spark, sf_dir, "part"), "p_brand").withColumn("share", F.round("share", 9))


@R.add("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def bars_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus").withColumn("total", F.round("total", 2))


@R.add("""
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 8) AS r
FROM lineitem GROUP BY 1
""")
def trend_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = charts.trend(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 8).alias("r"))


@R.add("""
WITH s AS (SELECT event_type, epoch(ts) AS x, value AS y FROM events), b AS (SELECT event_type, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1)
SELECT event_type, CAST(least(floor((x - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bucket, min(y) AS y_min, max(y) AS y_max FROM s JOIN b USING (event_type) GROUP BY 1, 2
""")
def line_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "value")
    return charts.decimated(held, "x", "value", "event_type", 50).drop("x_from")


@R.add("""
WITH s AS (SELECT l_returnflag AS layer, l_suppkey % 7 AS source, l_partkey % 40 AS target, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT layer, target, row_number() OVER (PARTITION BY layer ORDER BY sum(value) DESC, target) AS k FROM s GROUP BY 1, 2)
SELECT layer, source, CASE WHEN k < 10 THEN CAST(target AS VARCHAR) ELSE 'Other' END AS target, sum(value) AS value FROM s JOIN e USING (layer, target) GROUP BY 1, 2, 3
""")
def sankey_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), (F.col("l_suppkey") % 7).alias("source"), (F.col("l_partkey") % 40).alias("target"), "l_quantity")
    return charts.sankey(held, "layer", "source", "target", "l_quantity", 10)


@R.add("SELECT p_type, floor(p_retailprice / 25) * 25 AS \"from\", count(*) AS n FROM part GROUP BY 1, 2")
def laminar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.laminar_profile(table(spark, sf_dir, "part"), "p_retailprice", 25.0, "p_type").withColumn("from", F.col("from").cast("double"))


@R.add("""
SELECT p_type, p_partkey, place FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|11'), p_partkey) AS place FROM part) WHERE place <= 3
""")
def gallery_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.gallery(table(spark, sf_dir, "part"), "p_type", 3, 11, ("p_partkey",)).select("p_type", "p_partkey", "place")


@R.add("""
WITH s AS (SELECT user_id AS series, epoch_us(ts) / 1000000.0 AS t, avg(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT user_id AS series, 1704067200.0 + 86400.0 * k AS t FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(1, 30)) AS k)),
x AS (SELECT g.series, g.t, max(a.t) AS ta FROM g LEFT JOIN s a ON a.series = g.series AND a.t <= g.t GROUP BY 1, 2),
y AS (SELECT g.series, g.t, min(b.t) AS tb FROM g LEFT JOIN s b ON b.series = g.series AND b.t >= g.t GROUP BY 1, 2)
SELECT x.series, x.t, round(CASE WHEN ta = x.t THEN a.value WHEN tb = x.t THEN b.value ELSE a.value + (x.t - ta) / (tb - ta) * (b.value - a.value) END, 6) AS value
FROM x JOIN y ON x.series = y.series AND x.t = y.t LEFT JOIN s a ON a.series = x.series AND a.t = ta LEFT JOIN s b ON b.series = x.series AND b.t = tb
""")
def combine_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    held = events.select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    grid = events.select(F.col("user_id").alias("series")).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(29))))
    grid = grid.select("series", (F.lit(1704067200.0) + 86400.0 * F.col("k")).alias("t"))
    return traces.interpolated(held, grid).withColumn("value", F.round("value", 6))


@R.add("""
SELECT user_id AS series, floor(epoch_us(ts) / 1000000.0 / 3600) * 3600 AS t, round(avg(value), 6) AS value, count(*) AS n FROM events
WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY 1, 2
""")
def pooled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    out = traces.pooled(held, 3600.0, 1704412800.0, 1705017600.0)
    return out.select("series", F.col("t").cast("double").alias("t"), F.round("value", 6).alias("value"), "n")


@R.add("""
SELECT o_orderkey, row_number() OVER w AS rank, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER () AS DOUBLE), 9) AS share
FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)
""")
def rank_share_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    out = charts.rank_share(orders, "p", ("o_orderkey",))
    return out.select("o_orderkey", "rank", F.round(F.col("share").cast("double"), 9).alias("share"))
