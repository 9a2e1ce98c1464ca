"""Network operators over two networks of whole tables.

Customers to suppliers: how many order lines of a customer a supplier filled; both share a number range, so a supplier's node is
1,000,000 beyond its key. Parts to parts: which part follows which in an order, and how often; it has cycles, hubs and loops.
Where a query needs sources, they are the nodes whose id 50 divides; closeness takes all nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed, state_path
from loomgraph.operators import aggregates, joins, network
from loomgraph.plans.registry import Registry, table
from loomgraph.sources.edges import EdgeStore

R = Registry()
BEYOND = 1_000_000

_EDGES = "SELECT o_custkey AS source, 1000000 + l_suppkey AS target, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"
#: A network among nations: goods flow from the supplier's nation to the customer's, strong flows only.
_FLOWS = "SELECT s_nationkey AS source, c_nationkey AS target, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("supplier", F.col("l_suppkey") + BEYOND)
    return network.build(met, "o_custkey", "supplier").select("source", "target", "weight")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return network.build(met, "s_nationkey", "c_nationkey").select("source", "target", "weight")


#: Part after part: the line that follows another in its order.
_NEXT = "SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2"
_LINKED = f"WITH RECURSIVE e AS ({_NEXT}), u AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e WHERE source <> target), n AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u)"


def following(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    before = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source"))
    met = before.join(lines.withColumnRenamed("l_partkey", "target"), ["l_orderkey", "l_linenumber"])
    return network.build(met, "source", "target").select("source", "target", "weight")


def fiftieth(df: DataFrame) -> DataFrame:
    return network.nodes(df).where("id % 50 = 0")


@R.add(_EDGES)
def net_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@R.add(f"""
WITH e AS ({_EDGES}), o AS (SELECT source AS id, 1 AS o, 0 AS i, weight AS ow, 0 AS iw FROM e UNION ALL SELECT target, 0, 1, 0, weight FROM e)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(iw) AS BIGINT) AS in_weight, CAST(sum(ow) AS BIGINT) AS out_weight,
  CAST(sum(i) + sum(o) AS BIGINT) AS degree, CAST(sum(iw) + sum(ow) AS BIGINT) AS strength FROM o GROUP BY 1
""")
def net_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(edges(spark, sf_dir))


@R.add(_LINKED + """, d AS (SELECT x, count(*) AS degree FROM n GROUP BY 1),
t AS (SELECT p.x, count(*) AS c FROM n p JOIN n q ON p.x = q.x AND p.y < q.y JOIN u r ON r.a = p.y AND r.b = q.y GROUP BY 1)
SELECT d.x AS id, degree, coalesce(c, 0) AS triangles, round(CASE WHEN degree >= 2 THEN coalesce(c, 0) / (degree * (degree - 1) / 2) END, 9) AS clustering FROM d LEFT JOIN t USING (x)
""")
def net_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.triangles(following(spark, sf_dir)).withColumn("clustering", F.round("clustering", 9))


@R.add("""
WITH o AS (SELECT o_custkey AS root, o_orderkey FROM orders), n AS (SELECT root, root AS id FROM o UNION SELECT root, 10000000 + o_orderkey FROM o UNION SELECT root, 20000000 + 10 * l_orderkey + l_linenumber FROM o JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT root, count(*) AS size FROM n GROUP BY 1), k AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS component FROM s)
SELECT id, component, size FROM n JOIN k USING (root)
""")
def net_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, their orders and their lines: a tree a customer."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    placed = orders.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") + 10_000_000).alias("target"))
    held = lines.select((F.col("l_orderkey") + 10_000_000).alias("source"), (10 * F.col("l_orderkey") + F.col("l_linenumber") + 20_000_000).alias("target"))
    return network.components(placed.union(held))


@R.add(_LINKED + """, r(k, id, v) AS (SELECT 0, x, count(*) FROM n GROUP BY x UNION ALL SELECT k + 1, id, least(any_value(v), max(h)) FROM
  (SELECT s.k, s.x AS id, s.v, least(row_number() OVER (PARTITION BY s.x ORDER BY w.v DESC), w.v) AS h FROM (SELECT r.k, n.x, n.y, r.v FROM r JOIN n ON n.x = r.id WHERE r.k < 40) s JOIN r w ON w.id = s.y) GROUP BY k, id)
SELECT id, v AS coreness FROM r WHERE k = 40
""")
def net_coreness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.coreness(following(spark, sf_dir))


#: Links of more than one step twice over, and nodes without any.
_PARALLEL = _LINKED.replace(f"e AS ({_NEXT})", f"e AS (SELECT * FROM ({_NEXT}) UNION ALL SELECT * FROM ({_NEXT}) WHERE weight > 1)")


@R.add(_PARALLEL + """, a AS (SELECT DISTINCT source, target FROM e WHERE source <> target), d AS (SELECT x, count(*) AS k FROM n GROUP BY 1),
t AS (SELECT p.x, count(*) AS c FROM n p JOIN n q ON p.x = q.x AND p.y < q.y JOIN u r ON r.a = p.y AND r.b = q.y GROUP BY 1),
m AS (SELECT d.x, k, coalesce(c, 0) AS c FROM d LEFT JOIN t USING (x)), ids AS (SELECT source AS id FROM e UNION SELECT target FROM e UNION SELECT 10000000 + n_nationkey FROM nation),
g AS (SELECT ids.id, coalesce(deg, 0) AS deg FROM ids LEFT JOIN (SELECT id, count(*) AS deg FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1) USING (id)), z AS (SELECT CAST(count(*) AS DOUBLE) AS nn FROM ids),
w AS (SELECT i.k AS x, j.k AS y FROM n JOIN d i ON i.x = n.x JOIN d j ON j.x = n.y),
c(k, id, root) AS (SELECT 0, id, id FROM ids UNION ALL SELECT k + 1, id, min(root) FROM (SELECT c.k, n.y AS id, c.root FROM c JOIN (SELECT x, y FROM n UNION ALL SELECT id, id FROM ids) n ON n.x = c.id WHERE c.k < 12) GROUP BY k, id),
s AS (SELECT root, count(*) AS size FROM c WHERE k = 12 GROUP BY 1)
SELECT CAST(nn AS BIGINT) AS nodes, (SELECT count(*) FROM e) AS links, true AS directed, (SELECT count(*) FROM e WHERE source = target) AS self_loops, (SELECT count(*) FROM e WHERE source <> target) - (SELECT count(*) FROM a) AS parallel_links, (SELECT count(*) FROM g WHERE deg = 0) AS isolated,
  round((SELECT count(*) FROM a) / (nn * (nn - 1)), 9) AS density, (SELECT round(avg(deg), 9) FROM g) AS mean_degree, (SELECT median(deg) FROM g) AS median_degree, (SELECT max(deg) FROM g) AS max_degree,
  round((SELECT count(*) FROM a JOIN a q ON a.source = q.target AND a.target = q.source) / (SELECT count(*) FROM a), 9) AS reciprocity, (SELECT count(*) FROM s) AS components, (SELECT max(size) FROM s) AS largest_component,
  (SELECT round(avg(c / (k * (k - 1) / 2)) FILTER (k >= 2), 9) FROM m) AS mean_clustering, (SELECT round(sum(c) / sum(k * (k - 1) / 2), 9) FROM m) AS transitivity, (SELECT round(corr(x, y), 7) FROM w) AS assortativity,
  (SELECT CAST(sum(weight) AS DOUBLE) FROM e) AS total_weight, (SELECT round(avg(weight), 9) FROM e) AS mean_weight, (SELECT median(CAST(weight AS DOUBLE)) FROM e) AS median_weight, (SELECT CAST(max(weight) AS DOUBLE) FROM e) AS max_weight FROM z
""")
def net_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = following(spark, sf_dir)
    alone = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("id"))
    out = network.summary(e.union(e.where("weight > 1")), network.nodes(e).union(alone))
    return out.withColumns({**{c: F.round(c, 9) for c in ("mean_clustering", "density", "reciprocity", "transitivity", "mean_degree", "mean_weight")}, "assortativity": F.round("assortativity", 7)})


@R.add(_LINKED + """, r(id, hop) AS (SELECT DISTINCT x, 0 FROM n WHERE x % 50 = 0 UNION SELECT n.y, r.hop + 1 FROM r JOIN n ON n.x = r.id WHERE r.hop < 3)
SELECT id, min(hop) AS hop FROM r GROUP BY 1
""")
def net_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = following(spark, sf_dir).where("source <> target")
    return network.reach(e, fiftieth(e), 3, "any")


@R.add(_LINKED + """, k AS (SELECT x AS id FROM n WHERE x % 50 = 0 UNION SELECT target FROM e WHERE source % 50 = 0 AND source <> target)
SELECT source, target, weight FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)
""")
def net_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = following(spark, sf_dir)
    return network.filtered(e, fiftieth(e.where("source <> target")), "hops", 1, "downstream")


@R.add(f"""
WITH f AS ({_NEXT}), h1 AS (SELECT * FROM f WHERE source % 50 = 0), n1 AS (SELECT DISTINCT target AS id FROM h1 WHERE target NOT IN (SELECT source FROM f WHERE source % 50 = 0 UNION SELECT target FROM f WHERE target % 50 = 0)),
h2 AS (SELECT f.* FROM f WHERE source IN (SELECT id FROM n1)), a AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2),
k AS (SELECT source, target, any_value(weight) AS weight, min(hop) AS hop FROM a GROUP BY 1, 2), t AS (SELECT target, sum(weight) AS w FROM f GROUP BY 1)
SELECT k.source, k.target, k.weight, hop, 'outputs' AS direction, CAST(w AS BIGINT) AS weight_total, round(k.weight / w, 9) AS weight_norm FROM k JOIN t ON k.target = t.target
""")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = following(spark, sf_dir)
    return network.connectivity(every, fiftieth(every), 2, "outputs", 1, "postsynaptic").withColumn("weight_norm", F.round("weight_norm", 9))


@R.add(f"""
WITH RECURSIVE e AS (SELECT source, target, CAST(weight AS DOUBLE) AS w FROM ({_NEXT}) WHERE source <> target),
p(last, path, b) AS (SELECT 50, [50], CAST('inf' AS DOUBLE) UNION ALL SELECT e.target, list_append(p.path, e.target), least(p.b, e.w) FROM p JOIN e ON e.source = p.last WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.target))
SELECT array_to_string(route, '>') AS path, len(route) - 1 AS hops, b AS bottleneck, rank FROM (SELECT path AS route, b, row_number() OVER (ORDER BY b DESC, len(path), path) AS rank FROM p WHERE last IN (100, 150) AND len(path) > 1) WHERE rank <= 20
""")
def paths_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = following(spark, sf_dir)
    ids = network.nodes(every)
    out = network.paths(every, ids.where("id = 50"), ids.where("id IN (100, 150)"), 3, 20)
    return out.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "hops", "bottleneck", "rank")


@R.add(f"""
WITH f AS ({_NEXT}), w AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY target) AS w FROM f), m0 AS (SELECT DISTINCT id, 1.0 AS m FROM (SELECT source AS id FROM f UNION SELECT target FROM f) WHERE id % 50 = 0),
m1 AS (SELECT target AS id, sum(m * w * 0.5) AS m FROM m0 JOIN w ON id = source GROUP BY 1), m2 AS (SELECT target AS id, sum(m * w * 0.5) AS m FROM m1 JOIN w ON id = source GROUP BY 1),
m3 AS (SELECT target AS id, sum(m * w * 0.5) AS m FROM m2 JOIN w ON id = source GROUP BY 1)
SELECT id, round(sum(m), 8) AS influence FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3) GROUP BY 1
""")
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = following(spark, sf_dir)
    return network.influence(every, fiftieth(every), 3, 0.5).select("id", F.round("influence", 8).alias("influence"))


@R.add(f"""
WITH f AS ({_NEXT}), w AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY target) AS w FROM f), m0 AS (SELECT DISTINCT id AS q, id, 1.0 AS m FROM (SELECT source AS id FROM f UNION SELECT target FROM f) WHERE id % 50 = 0),
m1 AS (SELECT q, target AS id, sum(m * w * 0.5) AS m FROM m0 JOIN w ON id = source GROUP BY 1, 2), m2 AS (SELECT q, target AS id, sum(m * w * 0.5) AS m FROM m1 JOIN w ON id = source GROUP BY 1, 2)
SELECT q AS seed_id, id, round(sum(m), 8) AS influence, round(ln(greatest(sum(m), exp(-24))) + 24, 6) AS influence_log, min(hops) AS hops, min(hops) = 0 AS seed FROM (SELECT *, 0 AS hops FROM m0 UNION ALL SELECT *, 1 FROM m1 UNION ALL SELECT *, 2 FROM m2) GROUP BY 1, 2
""")
def influence_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = following(spark, sf_dir)
    out = network.influence(every, fiftieth(every), 2, 0.5, by_seed=True)
    return out.withColumns({"influence": F.round("influence", 8), "influence_log": F.round("influence_log", 6)})


#: Parts by brand, and how much of what a brand is followed by comes from each brand.
_BRANDS = f"""SELECT a.p_brand AS source, b.p_brand AS target, CAST(sum(weight) AS DOUBLE) AS w FROM ({_NEXT}) e JOIN part a ON a.p_partkey = source JOIN part b ON b.p_partkey = target GROUP BY 1, 2"""


@R.add(f"""
WITH RECURSIVE t AS ({_BRANDS}), e AS (SELECT source, target, w, w / sum(w) OVER (PARTITION BY target) AS n FROM t), k AS (SELECT * FROM e WHERE source <> target),
ends AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_partkey IN (50, 100, 150)),
p(last, path, b, n) AS (SELECT id, [id], CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE) FROM ends UNION ALL SELECT k.target, list_append(p.path, k.target), least(p.b, k.w), least(p.n, k.n) FROM p JOIN k ON k.source = p.last WHERE len(p.path) <= 2 AND NOT list_contains(p.path, k.target))
SELECT array_to_string(route, '>') AS path, len(route) - 1 AS hops, b AS bottleneck, round(n, 9) AS bottleneck_norm, rank FROM (SELECT path AS route, b, n, row_number() OVER (ORDER BY n DESC, len(path), path) AS rank FROM p WHERE last IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 50 = 25) AND len(path) > 1) WHERE rank <= 20
""")
def paths_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths among brands, by the least share that a step has in what its target receives."""
    every = following(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    out = network.paths(every, parts.where("id IN (50, 100, 150)"), parts.where("id % 50 = 25"), 2, 20, labels=parts, normalize_by="postsynaptic", rank_by="fraction")
    return out.select(F.array_join("path", ">").alias("path"), "hops", "bottleneck", F.round("bottleneck_norm", 9).alias("bottleneck_norm"), "rank")


@R.add(f"""
WITH f AS ({_NEXT}), o AS (SELECT source AS id, count(*) AS n_out, CAST(sum(weight) AS BIGINT) AS out_weight FROM f GROUP BY 1), i AS (SELECT target AS id, count(*) AS n_in, CAST(sum(weight) AS BIGINT) AS in_weight FROM f GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, coalesce(n_out, 0) AS n_out, coalesce(out_weight, 0) AS out_weight, coalesce(n_in, 0) AS n_in, coalesce(in_weight, 0) AS in_weight FROM o FULL JOIN i ON o.id = i.id
""")
def edge_store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EdgeStore.save(following(spark, sf_dir), state_path(spark)).totals()


@R.add(f"""
WITH f AS ({_NEXT}), l AS (SELECT p_partkey AS id, p_brand AS label FROM part)
SELECT coalesce(a.label, CAST(source AS VARCHAR)) AS source, coalesce(b.label, CAST(target AS VARCHAR)) AS target, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS pairs FROM f LEFT JOIN l a ON a.id = source LEFT JOIN l b ON b.id = target WHERE target % 50 = 0 GROUP BY 1, 2
""")
def edge_store_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = following(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    store = EdgeStore.save(every, state_path(spark))
    return store.step(parts.where("id % 50 = 0"), "inputs", parts)


@R.add(f"""
WITH RECURSIVE f AS ({_NEXT}), a AS (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS p FROM f WHERE source <> target),
ids AS (SELECT source AS id FROM f UNION SELECT target FROM f), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ids),
q AS (SELECT source, target, p FROM a UNION ALL SELECT i.id, j.id, 1 / n FROM ids i, ids j, c WHERE i.id NOT IN (SELECT source FROM a) UNION ALL SELECT id, id, 0 FROM ids),
r(k, id, v) AS (SELECT 0, id, 1 / n FROM ids, c UNION ALL SELECT k + 1, id, v FROM (SELECT r.k, q.target AS id, 0.15 / max(n) + 0.85 * sum(r.v * q.p) AS v FROM r JOIN q ON q.source = r.id, c GROUP BY r.k, q.target) WHERE k < 15)
SELECT id, round(v, 9) AS pagerank FROM r WHERE k = 15
""")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pagerank(following(spark, sf_dir), rounds=15, tolerance=0).withColumn("pagerank", F.round("pagerank", 9))


@R.add(f"""
WITH RECURSIVE f AS ({_NEXT}), b AS (SELECT source, target, CAST(sum(weight) AS DOUBLE) AS w FROM (SELECT * FROM f UNION ALL SELECT target, source, weight FROM f) WHERE source <> target GROUP BY 1, 2),
ids AS (SELECT source AS id FROM f UNION SELECT target FROM f), q AS (SELECT * FROM b UNION ALL SELECT id, id, 1 FROM ids),
r(k, id, v) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM ids UNION ALL SELECT k + 1, id, v / sqrt(sum(v * v) OVER ()) FROM (SELECT r.k, q.target AS id, sum(r.v * q.w) AS v FROM r JOIN q ON q.source = r.id WHERE r.k < 10 GROUP BY r.k, q.target))
SELECT id, round(v, 9) AS eigenvector FROM r WHERE k = 10
""")
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.eigenvector(following(spark, sf_dir), rounds=10, tolerance=0).withColumn("eigenvector", F.round("eigenvector", 9))


@R.add(_LINKED + """, r(id, node, hop) AS (SELECT DISTINCT x, x, 0 FROM n UNION SELECT r.id, n.y, r.hop + 1 FROM r JOIN n ON n.x = r.node WHERE r.hop < 5),
d AS (SELECT id, node, min(hop) AS hop FROM r GROUP BY 1, 2)
SELECT id, count(*) AS reached, round(count(*) / sum(hop), 9) AS closeness FROM d WHERE hop > 0 GROUP BY 1
""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = checkpointed(following(spark, sf_dir).where("source <> target"))
    return network.closeness(e, network.nodes(e), 5).withColumn("closeness", F.round("closeness", 9))


@R.add(f"""
WITH e AS ({_NEXT})
SELECT p.source AS a, p.target AS b, q.target AS c FROM e p JOIN e q ON p.target = q.source JOIN e r ON r.source = q.target AND r.target = p.source
WHERE p.source <> p.target AND q.source <> q.target AND p.source <> q.target AND NOT EXISTS (SELECT 1 FROM e z WHERE z.source = p.target AND z.target = p.source)
""")
def motif_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.motif(following(spark, sf_dir), [("a", "b"), ("b", "c"), ("c", "a")], [("b", "a")])


@R.add(f"""
WITH e AS ({_NEXT}) SELECT p.source AS a, p.target AS b, q.target AS c FROM e p JOIN e q ON p.target = q.source JOIN part x ON x.p_partkey = p.source JOIN part y ON y.p_partkey = q.target
WHERE p.source <> p.target AND q.source <> q.target AND p.source <> q.target AND x.p_size > 30 AND y.p_brand = 'Brand#11' AND p.weight > 1 AND NOT EXISTS (SELECT 1 FROM e z WHERE z.source = q.target AND z.target = p.source AND z.weight > 1)
""")
def motif_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from a large part over a repeated step to a part of one brand, without a repeated step back."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    where = {("a", "b"): "weight > 1", ("c", "a"): "weight > 1"}
    return network.motif(following(spark, sf_dir), [("a", "b"), ("b", "c")], [("c", "a")], parts, {"a": "p_size > 30", "c": "p_brand = 'Brand#11'"}, where)


@R.add("""
WITH n AS (SELECT 10 * l_orderkey + l_linenumber AS sv, min(l_suppkey) AS new FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(n.new, l_suppkey) AS l_suppkey FROM lineitem LEFT JOIN n ON n.sv = CASE WHEN l_linestatus = 'F' THEN 10 * l_orderkey + l_linenumber END
""")
def update_ids_by_supervoxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    place = (10 * F.col("l_orderkey") + F.col("l_linenumber")).alias("supervoxel")
    lookup = lines.where("l_returnflag = 'R'").groupBy(place).agg(F.min("l_suppkey").alias("new"))
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "F", place).alias("sv"))
    return joins.update_ids_by_supervoxel(rows, lookup, "l_suppkey", "sv").drop("sv")


@R.add(f"""
WITH RECURSIVE e AS ({_NEXT}), r(id, layer) AS (SELECT DISTINCT id, 0 FROM (SELECT source AS id FROM e UNION SELECT target FROM e) WHERE id % 50 = 0 UNION SELECT e.target, r.layer + 1 FROM r JOIN e ON e.source = r.id WHERE e.source <> e.target AND r.layer < 6)
SELECT id, max(layer) AS layer FROM r GROUP BY 1
""")
def flow_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = checkpointed(following(spark, sf_dir))
    return network.layers(every, fiftieth(every), 6)


@R.add(f"""
WITH e AS (SELECT * FROM ({_EDGES}) WHERE source % 50 = 0), t AS (SELECT 1000000 + s_suppkey AS id, CASE WHEN s_nationkey < 20 THEN 'N' || s_nationkey END AS label FROM supplier),
l AS (SELECT source AS id, 'out:' || coalesce(label, CAST(target AS VARCHAR)) AS feature, weight, sum(weight) OVER (PARTITION BY source) AS total FROM e LEFT JOIN t ON t.id = target)
SELECT id, feature, round(sum(weight / total), 9) AS value FROM l GROUP BY 1, 2
""")
def partner_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).toDF("pre", "post", "weight")
    labels = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + BEYOND).alias("id"), F.when(F.col("s_nationkey") < 20, F.concat(F.lit("N"), "s_nationkey")).alias("label"))
    queries = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"))
    return joins.partner_vectors(e, queries, labels, weighting="fraction").withColumn("value", F.round("value", 9))


@R.add("""
WITH e AS (SELECT o_orderstatus AS s, c_mktsegment AS pre_label, 'S' || s_suppkey AS post_label, s_nationkey, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE (o_orderstatus <> 'O' OR s_nationkey >= 5) AND (o_orderstatus <> 'P' OR c_mktsegment <> 'BUILDING') GROUP BY 1, 2, 3, 4)
SELECT pre_label, post_label, CAST(coalesce(sum(w) FILTER (s = 'F'), 0) AS BIGINT) AS weight_F, CASE WHEN s_nationkey >= 5 THEN CAST(coalesce(sum(w) FILTER (s = 'O'), 0) AS BIGINT) END AS weight_O,
  CASE WHEN pre_label <> 'BUILDING' THEN CAST(coalesce(sum(w) FILTER (s = 'P'), 0) AS BIGINT) END AS weight_P, true AS present_F, s_nationkey >= 5 AS present_O, pre_label <> 'BUILDING' AS present_P FROM e GROUP BY pre_label, post_label, s_nationkey
""")
def compare_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets of segments and suppliers; one never sampled the suppliers of some nations, one a segment."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = met.select("o_orderstatus", F.col("o_custkey").alias("pre"), (F.col("l_suppkey") + BEYOND).alias("post"), F.lit(1).alias("weight"))
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def labels(c: DataFrame, s: DataFrame) -> DataFrame:
        return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")).union(s.select(F.col("s_suppkey") + BEYOND, F.concat(F.lit("S"), "s_suppkey")))

    sampled = {"F": labels(customers, suppliers), "O": labels(customers, suppliers.where("s_nationkey >= 5")), "P": labels(customers.where("c_mktsegment <> 'BUILDING'"), suppliers)}
    return joins.compare_connectivity({s: met.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"}, sampled)


@R.add("""
SELECT CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS pre, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS post, l_linestatus, count(*) AS weight FROM lineitem GROUP BY 1, 2, 3
""")
def synapse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("neuron"), F.col("l_suppkey").alias("partner"), F.when(F.col("l_returnflag") == "R", "post").otherwise("pre").alias("polarity"), "l_linestatus")
    return joins.synapse_edges(points, by=("l_linestatus",))


@R.add(f"""
WITH e AS (SELECT * FROM ({_EDGES}) WHERE source IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND target IN (SELECT 1000000 + s_suppkey FROM supplier WHERE s_acctbal > 5000))
SELECT 'BUILDING' AS row, 'N' || s_nationkey AS col, CAST(sum(weight) AS BIGINT) AS value FROM e JOIN supplier ON target = 1000000 + s_suppkey GROUP BY 2
""")
def adjacency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).toDF("pre", "post", "weight")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    labels = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")).union(s.select(F.col("s_suppkey") + BEYOND, F.concat(F.lit("N"), "s_nationkey")))
    return aggregates.adjacency(e, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")), s.where("s_acctbal > 5000").select((F.col("s_suppkey") + BEYOND).alias("id")), labels)


@R.add(f"SELECT source AS row, target AS col, weight AS value FROM ({_FLOWS})")
def region_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.region_connectivity(flows(spark, sf_dir), "source", "target")


@R.add(f"""
WITH e AS ({_EDGES}), t AS (SELECT source AS id, 'N' || s_nationkey AS partner_type, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT target) AS partners FROM e JOIN supplier ON target = 1000000 + s_suppkey GROUP BY 1, 2),
r AS (SELECT *, weight / sum(weight) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY weight DESC, partner_type) AS rank FROM t)
SELECT id, partner_type, weight, partners, round(share, 9) AS share, rank FROM r WHERE rank <= 3
""")
def neuron_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + BEYOND).alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("label"))
    return aggregates.profile(edges(spark, sf_dir).toDF("pre", "post", "weight"), labels, 3).withColumn("share", F.round("share", 9))


@R.add("""
WITH h AS (SELECT DISTINCT o_orderstatus AS dataset, o_custkey AS id, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'
  UNION SELECT 'F', c_custkey, 'B-only' FROM customer WHERE c_mktsegment = 'BUILDING'),
n AS (SELECT label AS type, dataset, count(DISTINCT id) AS n_neurons FROM h GROUP BY 1, 2), m AS (SELECT type, count(*) = 3 AS matched, max(n_neurons) > 5 * min(n_neurons) AS far FROM n GROUP BY 1)
SELECT type, dataset, n_neurons, matched, matched AND far AS suspicious FROM n JOIN m USING (type)
""")
def match_types_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    seen = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).where("c_mktsegment <> 'BUILDING'")
    seen = seen.select(F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    alone = customers.where("c_mktsegment = 'BUILDING'").select(F.lit("F"), "c_custkey", F.lit("B-only"))
    return network.match_types(seen.union(alone), 3)[1]


_SIDES = "SELECT o_custkey AS pre, 1000000 + l_suppkey AS post, CASE l_returnflag WHEN 'A' THEN 'axon' WHEN 'N' THEN 'dendrite' END AS a, CASE WHEN l_linestatus = 'F' THEN 'axon' WHEN l_quantity > 25 THEN 'linker' ELSE 'dendrite' END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@R.add(f"""
WITH s AS ({_SIDES}) SELECT pre AS "preId", post AS "postId", count(*) AS weight, count(*) FILTER (a = 'axon' AND b = 'axon') AS "weightAxonAxon", count(*) FILTER (a = 'axon' AND b = 'dendrite') AS "weightAxonDendrite",
  count(*) FILTER (a = 'dendrite' AND b = 'axon') AS "weightDendriteAxon", count(*) FILTER (a = 'dendrite' AND b = 'dendrite') AS "weightDendriteDendrite", count(*) FILTER (a IS NOT NULL AND b = 'linker') AS "weightLinker",
  count(*) FILTER (a IS NULL) AS "weightUnsplit", count(*) AS synapses FROM s GROUP BY 1, 2
""")
def connection_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = F.when(F.col("l_returnflag") == "A", "axon").when(F.col("l_returnflag") == "N", "dendrite")
    b = F.when(F.col("l_linestatus") == "F", "axon").when(F.col("l_quantity") > 25, "linker").otherwise("dendrite")
    synapses = lines.select(F.col("o_custkey").alias("pre"), (F.col("l_suppkey") + BEYOND).alias("post"), a.alias("pre_compartment"), b.alias("post_compartment"))
    return joins.connection_compartments(edges(spark, sf_dir).toDF("preId", "postId", "weight"), synapses)
