"""Row, join and aggregation operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import aggregates, joins, rows
from loomgraph.plans.registry import Registry, table

R = Registry()
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


@R.add("""
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 10 GROUP BY 1
""")
def flagship_priority_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rows.filter_table(table(spark, sf_dir, "lineitem"), "l_quantity", "ge", 10).select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = joins.join(lines, orders, "l_orderkey", "o_orderkey", "inner", order=("o_orderpriority",))
    out = joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("sum_l_extendedprice"), F.count_distinct("l_suppkey").alias("suppliers"))
    return rows.sort(out, "sum_l_extendedprice", descending=True)


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 10")
def filter_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rows.filter_table(rows.filter_table(table(spark, sf_dir, "lineitem"), "l_discount", "ge", 0.05), "l_quantity", "lt", 10)
    return rows.select_columns(kept, ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"])


@R.add("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d FROM lineitem WHERE coalesce(nullif(l_discount, 0), 0) = 0")
def filter_missing_equals_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return rows.filter_table(lines, "d", "eq", 0)


@R.add("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*[gt]$') AND NOT contains(p_name, 'bolt')")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rows.filter_table(rows.filter_table(part, "p_name", "matches", "^(red|blue) .*[gt]$"), "p_name", "notContains", "bolt")


@R.add("""
SELECT p_partkey, p_name, p_type, p_size FROM part
WHERE lower(p_type) IN ('promo', 'small') AND NOT coalesce(regexp_full_match(p_name, 'red .*'), false) AND p_size > 20
""")
def filter_rows_anded(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [
        {"column": "p_type", "op": "isIn", "value": ["Promo", "SMALL"], "ignore_case": True},
        {"column": "p_name", "op": "isNot", "value": "x"},
        {"column": "p_size", "op": "gt", "value": 20},
    ]
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    _, rest = rows.split_rows(rows.filter_rows(part, wanted), [{"column": "p_name", "op": "matches", "value": "red .*"}])
    return rest


@R.add("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_size <= 30 AND contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'red')")
def filter_header_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.functions.predicates import cell_filter

    part = table(spark, sf_dir, "part")
    return part.where(cell_filter(part, "p_size", ">10, <=30") & cell_filter(part, "p_name", "RING, !red")).select("p_partkey", "p_name")


@R.add("SELECT n_regionkey AS n_nationkey, n_nationkey AS n_regionkey, n_name AS n_name_2, n_name AS n_name FROM nation")
def rename_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("label", F.col("n_name"))
    return rows.rename_columns(nation, {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "label": "n_name"})


@R.add("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.sort(orders, "o_totalprice", descending=True, limit=100, order=("o_orderkey",))


@R.add("SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) WHERE (r - 1) % 7 = 0")
def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "stride", ("s_suppkey",), step=7)


@R.add("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def sample_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "tail", ("o_orderkey",), count=50)


@R.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), coalesce(CAST(o_custkey AS VARCHAR), ''), '3')), o_orderkey LIMIT 200")
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "random", ("o_orderkey",), count=200, seed=3)


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "head", ("o_orderkey",), count=50)


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 1 OFFSET 7)")
def select_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.select_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 7, "o_custkey", ("o_orderkey",))


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dedupe(table(spark, sf_dir, "orders"), ["o_custkey"], "first", ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dedupe(table(spark, sf_dir, "orders"), ["o_custkey"], "last", ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey) = 1")
def dedupe_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dedupe(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey", "l_suppkey"], "none", ("l_partkey",))


@R.add("""
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, CASE WHEN p_size > 10 THEN p_type END, p_name) AS label,
  CASE WHEN p_size > 25 THEN 'a' WHEN p_size > 10 THEN 'b' ELSE 'p_name' END AS origin FROM part
""")
def combine_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("  ").alias("a"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("b"))
    return rows.combine_columns(part, ["a", "b", "p_name"], "label", "origin").select("p_partkey", "label", "origin")


_MAP = "SELECT n_nationkey AS k, any_value(n_name) AS v FROM nation WHERE n_nationkey < 15 GROUP BY 1"


@R.add(f"SELECT c_custkey, coalesce(v, CAST(c_nationkey AS VARCHAR)) AS c_nationkey FROM customer LEFT JOIN ({_MAP}) ON c_nationkey = k")
def relabel_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 15")
    return rows.relabel(table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_nationkey", "n_name", "keep").select("c_custkey", "c_nationkey")


@R.add(f"SELECT c_custkey, v AS nation FROM customer JOIN ({_MAP}) ON c_nationkey = k")
def relabel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 15")
    return rows.relabel(table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_nationkey", "n_name", "drop", into="nation").select("c_custkey", "nation")


@R.add(f"SELECT c_custkey, v AS nation FROM customer LEFT JOIN ({_MAP}) ON c_nationkey = k")
def relabel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 15")
    return rows.relabel(table(spark, sf_dir, "customer"), nations, "c_nationkey", "n_nationkey", "n_name", "null", into="nation").select("c_custkey", "nation")


@R.add("""
SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'huge' WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_totalprice > 400000 THEN 'yes' END AS flag FROM orders
""")
def edit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = [
        {"where": [{"column": "o_orderstatus", "op": "is", "value": "P"}], "column": "o_orderstatus", "value": "pending"},
        {"where": [{"column": "o_totalprice", "op": "gt", "value": 400000}], "column": "o_orderstatus", "value": "huge"},
        {"where": [{"column": "o_orderstatus", "op": "is", "value": "huge"}], "column": "flag", "value": "yes"},
    ]
    return rows.edit_table(table(spark, sf_dir, "orders"), edits).select("o_orderkey", "o_orderstatus", "flag")


@R.add("SELECT 'shop:' || CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey AS VARCHAR) AS back FROM supplier")
def qualify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.qualify_ids(table(spark, sf_dir, "supplier"), "s_suppkey", "shop", into="id")
    return rows.qualify_ids(out, "id", "shop", "strip", into="back").select("id", "back")


@R.add("""
SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.unpivot(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@R.add("""
SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment, 'supplier' AS kind FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'customer' FROM customer
""")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return rows.stack({"supplier": s, "customer": c}, "kind")


@R.add("""
SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red ring' OR lower(p_type) = 'red ring' THEN 0 WHEN starts_with(lower(p_name), 'red ring') THEN 1 ELSE 2 END AS relevance
FROM part WHERE contains(lower(p_name), 'red ring') ORDER BY relevance, p_partkey LIMIT 50
""")
def explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.explore(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "Red ring", ["p_name", "p_type"], 50, ("p_partkey",)).select("p_partkey", "p_name", "relevance")


@R.add("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(lower(p_name), 'red .*|hot gear')")
def ids_from_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.ids_from_label(table(spark, sf_dir, "part"), "p_name", ["RED .*", "hot gear"], "regex", ignore_case=True).select("p_partkey", "p_name")


def _partial(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders by customer, and customers without one segment, whose names repeat."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment")
    return orders, customers


_CUST = "(SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')"


@R.add(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN {_CUST} ON o_custkey = c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(*_partial(spark, sf_dir), "o_custkey", "c_custkey", "left", order=("c_name",))


@R.add(f"SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN {_CUST} ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(*_partial(spark, sf_dir), "o_custkey", "c_custkey", "inner", order=("c_name",))


@R.add(f"""
SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, o_totalprice, c_name, c_mktsegment
FROM orders FULL JOIN {_CUST} ON o_custkey = c_custkey
""")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(*_partial(spark, sf_dir), "o_custkey", "c_custkey", "outer", order=("c_name",))


@R.add(f"""
SELECT o_orderkey, c_custkey AS o_custkey, o_totalprice, c_name, c_mktsegment FROM
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) RIGHT JOIN {_CUST} ON o_custkey = c_custkey
""")
def join_right_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(*_partial(spark, sf_dir), "o_custkey", "c_custkey", "right", order=("o_orderkey",))


@R.add("""
SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label FROM
(SELECT c_custkey AS id, c_mktsegment AS label FROM customer) a FULL JOIN
(SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN s_name END AS label FROM supplier) b ON a.id = b.id
""")
def overlay_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("label"))
    return joins.overlay(a, b, "id")


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.semi(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").where("c_acctbal < 0"), "o_custkey", "c_custkey")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.anti(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1, 2")
def group_by_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.group_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "sum", ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 2) for c in ("sum_l_quantity", "sum_l_extendedprice")})


@R.add("SELECT c_mktsegment, count(*) AS n, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) AS mean_b FROM customer GROUP BY 1")
def group_by_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").withColumn("b", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return aggregates.group_by(held, ["c_mktsegment"], "mean", ["b"]).withColumn("mean_b", F.round("mean_b", 4))


@R.add("SELECT o_custkey, count(*) AS n, min(o_totalprice) AS min_o_totalprice, min(o_orderpriority) AS min_o_orderpriority FROM orders GROUP BY 1")
def group_by_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_by(table(spark, sf_dir, "orders"), ["o_custkey"], "min", ["o_totalprice", "o_orderpriority"])


@R.add("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS countDistinct_l_partkey FROM lineitem GROUP BY 1")
def group_by_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "countDistinct", ["l_partkey"])


@R.add("SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS join_o_orderpriority FROM orders GROUP BY 1")
def group_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_by(table(spark, sf_dir, "orders"), ["o_custkey"], "join", ["o_orderpriority"])


@R.add("""
SELECT l_returnflag, round(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0), 2) AS "F",
  round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0), 2) AS "O" FROM lineitem GROUP BY 1
""")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "sum", "l_quantity")
    return out.select("l_returnflag", *[F.round(c, 2).alias(c) for c in ("F", "O")])


_MATRIX = "(SELECT CAST(l_suppkey AS VARCHAR) AS row, p_type AS col, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.pivot_long(lines, "l_suppkey", "p_type", "sum", "l_quantity")


@R.add(f"""
SELECT row AS label, count(value) AS n, sum(value) AS sum, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, median(value) AS median
FROM {_MATRIX} GROUP BY 1
""")
def reduce_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_matrix(_matrix(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@R.add(f"SELECT row, col, round(value / sum(value) OVER (PARTITION BY row), 9) AS value FROM {_MATRIX}")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.normalize(_matrix(spark, sf_dir), "row").withColumn("value", F.round("value", 9))


@R.add(f"SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 9) AS value FROM {_MATRIX}")
def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.normalize(_matrix(spark, sf_dir), "column").withColumn("value", F.round("value", 9))


@R.add(f"SELECT row, col, round(value / max(abs(value)) OVER (), 9) AS value FROM {_MATRIX}")
def normalize_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.normalize(_matrix(spark, sf_dir), "max").withColumn("value", F.round("value", 9))


@R.add("SELECT l_suppkey, count(*) AS n, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def group_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "max", ["l_quantity"])


@R.add(f"SELECT row, col, round(log10(1 + value), 9) AS value FROM {_MATRIX}")
def normalize_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.normalize(_matrix(spark, sf_dir), "log").withColumn("value", F.round("value", 9))


@R.add("""
SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(o_orderkey) AS non_nulls, count(*) - count(o_orderkey) AS nulls, CAST(NULL AS BIGINT) AS non_zero, count(DISTINCT o_orderkey) AS "unique",
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice), count(*) - count(o_totalprice), count(*) FILTER (o_totalprice <> 0), count(DISTINCT o_totalprice), min(o_totalprice),
  quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), max(o_totalprice), round(avg(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), count(*) - count(o_orderpriority), NULL, count(DISTINCT o_orderpriority), NULL, NULL, NULL, NULL, NULL, NULL FROM orders
""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.describe(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), id_column="o_orderkey")
    return out.withColumn("mean", F.round("mean", 4))


@R.add("""
SELECT n_name, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS traced, round(sum(o_totalprice), 2) AS total,
  round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) / sum(o_totalprice), 9) AS ratio
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = aggregates.completeness(held, "n_name", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.select("n_name", F.round("traced", 2).alias("traced"), F.round("total", 2).alias("total"), F.round("ratio", 9).alias("ratio"))


@R.add("""
SELECT 'o_orderstatus' AS attribute, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@R.add("""
SELECT l_suppkey, l_partkey, n, rank FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rank
FROM lineitem GROUP BY 1, 2) WHERE rank <= 3
""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return aggregates.top_per_group(counts, ["l_suppkey"], "n", 3, ("l_partkey",))


@R.add("SELECT n_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def attach_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.attach(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), regions, "n_regionkey", ("r_name",))


@R.add("""
SELECT o.o_orderkey, coalesce(m.new, o.o_custkey) AS o_custkey FROM orders o LEFT JOIN
(SELECT old, new FROM (SELECT o_custkey AS old, l_suppkey AS new, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY old ORDER BY n DESC, new) = 1) m ON o.o_custkey = m.old
""")
def update_ids_by_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    votes = lines.select(F.col("o_custkey").alias("old"), F.col("l_suppkey").alias("new"))
    return joins.update_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), votes, "o_custkey")


@R.add(f"SELECT row AS label, row_number() OVER (ORDER BY t DESC, row) - 1 AS place FROM (SELECT row, sum(value) AS t FROM {_MATRIX} GROUP BY 1)")
def heatmap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators import flow

    return flow.ordered_lines(_matrix(spark, sf_dir), "total")


@R.add("""
WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS r, o_totalprice FROM orders),
f AS (SELECT o_orderpriority, min(r) AS first FROM o GROUP BY 1), p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS pass_at FROM f)
SELECT pass_at, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o JOIN p USING (o_orderpriority) WHERE pass_at < 4 GROUP BY 1
""")
def for_each_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators import flow

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    total = lambda d: d.groupBy("pass_at").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return flow.for_each(orders, ("o_orderkey",), total, group="o_orderpriority", limit=4)
