"""Geometry, sources and event time over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed
from loomgraph.operators import geometry, linkage, meshes, network, similarity
from loomgraph.plans import graphs, likeness
from loomgraph.plans.registry import Registry, table
from loomgraph.sources import tables as sources
from loomgraph.sources.dataset import Dataset
from loomgraph.streaming import events as event_time

R = Registry()
_POINTS = "SELECT label AS id, vec_id AS at, round(CAST(embedding[1] AS DOUBLE) * 100, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 100, 4) AS y, round(CAST(embedding[3] AS DOUBLE) * 100, 4) AS z FROM embeddings"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each embedding as a point of its label."""
    xyz = [F.round(F.element_at("embedding", i + 1).cast("double") * 100, 4).alias(c) for i, c in enumerate(geometry.AXES)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("at"), *xyz)


@R.add(f"""SELECT "at", round(2 * y + 1, 6) AS x, round(10 - x, 6) AS y, round(z * 0.5 + x, 6) AS z FROM ({_POINTS})""")
def transform_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = geometry.affine(geometry.mirrored(points(spark, sf_dir), "x", 5.0), [[0, 2, 0, 1], [1, 0, 0, 0], [-1, 0, 0.5, 10]])
    return moved.select("at", *[F.round(c, 6).alias(c) for c in geometry.AXES])


@R.add(f"""
WITH c AS (SELECT id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({_POINTS}) GROUP BY 1)
SELECT a.id AS row, b.id AS col, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS value FROM c a, c b
""")
def distance_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return geometry.centroid_distance(p, p).withColumn("value", F.round("value", 6))


@R.add(f"""
WITH p AS ({_POINTS}), d AS (SELECT a.id AS row, a.at, b.id AS col, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d2 FROM p a JOIN p b ON a.id <> b.id
WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 9 GROUP BY 1, 2, 3)
SELECT row, col, round(median(sqrt(d2)), 6) AS value FROM d GROUP BY 1, 2
""")
def distance_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return geometry.nearest_distance(p, p, 3.0, "median").where("row <> col").withColumn("value", F.round("value", 6))


@R.add(f"""
WITH p AS ({_POINTS}), h AS (SELECT DISTINCT a.id AS row, a.at, b.id AS col FROM p a, p b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 9 AND a.id <> b.id),
s AS (SELECT id, count(*) AS size FROM p GROUP BY 1) SELECT row, col, count(*) AS n, round(count(*) / any_value(size), 9) AS share FROM h JOIN s ON row = s.id GROUP BY 1, 2
""")
def distance_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return geometry.close_share(p, p, 3.0).where("row <> col").withColumn("share", F.round("share", 9))


@R.add(f"""
WITH p AS ({_POINTS}), d AS (SELECT a.id AS row, a.at, b.id AS col, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d2 FROM p a JOIN p b ON a.id <> b.id
WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 9 GROUP BY 1, 2, 3), m AS (SELECT row, col, avg(sqrt(d2)) AS value FROM d GROUP BY 1, 2)
SELECT m.row, m.col, round((m.value + w.value) / 2, 6) AS value FROM m JOIN m w ON w.row = m.col AND w.col = m.row
""")
def distance_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return geometry.nearest_distance(p, p, 3.0, "mean", "mean").where("row <> col").withColumn("value", F.round("value", 6))


_BOXES = "SELECT n_name AS roi, n_nationkey - 15.0 AS x0, n_nationkey - 9.0 AS x1, -8.0 AS y0, 2.0 * n_regionkey AS y1, -20.0 AS z0, 20.0 AS z1 FROM nation"


@R.add(f"""SELECT "at", roi FROM ({_POINTS}) JOIN ({_BOXES}) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda v: F.lit(float(v))
    boxes = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("roi"), (F.col("n_nationkey") - lit(15)).alias("x0"), (F.col("n_nationkey") - lit(9)).alias("x1"), lit(-8).alias("y0"), (2 * F.col("n_regionkey").cast("double")).alias("y1"), lit(-20).alias("z0"), lit(20).alias("z1")
    )
    return geometry.in_boxes(points(spark, sf_dir), boxes, 10.0).select("at", "roi")


@R.add(f"""SELECT p."at", min(roi) AS roi FROM ({_POINTS}) p LEFT JOIN ({_BOXES}) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1 GROUP BY 1""")
def points_in_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as closed surfaces of twelve triangles; where they overlap the first by name has the point."""
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    triangles = [[corners[q[n]] for n in (0, i, i + 1)] for q in quads for i in (1, 2)]
    name, region = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    edges = {"x": (name - 15, name - 9), "y": (F.lit(-8.0), 2 * region), "z": (F.lit(-20.0), F.lit(20.0))}
    faces = F.array(*[F.struct(*[edges[c][corner[n]].alias(f"{which}{c}") for which, corner in zip("abc", t) for n, c in enumerate("xyz")]) for t in triangles])
    meshed = table(spark, sf_dir, "nation").select(F.col("n_name").alias("roi"), F.explode(faces).alias("t")).select("roi", "t.*")
    return meshes.in_meshes(points(spark, sf_dir).drop("id"), meshed).select("at", "roi")


@R.add(f"""SELECT "at", CASE WHEN z < -10 THEN 'L1' WHEN z < 0 THEN 'L2' WHEN z < 10 THEN 'L3' END AS layer FROM ({_POINTS})""")
def depth_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.layered(points(spark, sf_dir), "z", {"L1": -10.0, "L2": 0.0, "L3": 10.0}).select("at", "layer")


@R.add("""
WITH n AS (SELECT user_id AS id, event_id AS node, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS parent, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM events),
k AS (SELECT id, parent AS node, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY 1, 2)
SELECT n.id, count(*) AS n_nodes, round(coalesce(sum(sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2))), 0), 4) AS cable, count(*) FILTER (coalesce(kids, 0) > 1) AS branch_points,
  count(*) FILTER (coalesce(kids, 0) = 0) AS end_points, count(*) FILTER (n.parent IS NULL) AS roots, round(sqrt(pow(max(n.x) - min(n.x), 2) + pow(max(n.y) - min(n.y), 2)), 4) AS extent
FROM n LEFT JOIN n p ON p.id = n.id AND p.node = n.parent LEFT JOIN k ON k.id = n.id AND k.node = n.node GROUP BY 1
""")
def skeleton_cable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    parent = F.lag("event_id", 2).over(W.partitionBy("user_id").orderBy("event_id"))
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("node"), parent.alias("parent"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return geometry.cable(nodes).withColumns({c: F.round(c, 4) for c in ("cable", "extent")})


@R.add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_time.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@R.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_time.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_totalprice >= 200000")
def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = sources.link(spark, f"{sf_dir}/orders.parquet").where("o_totalprice >= 200000")
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")
    return sources.read_rows(file, ["o_orderkey", "o_totalprice"], ids, "o_custkey", "c_custkey")


def _dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    neurons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("size"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.groupBy(F.col("o_custkey").alias("pre"), (F.col("l_suppkey") + graphs.BEYOND).alias("post"), F.col("l_returnflag").alias("region")).agg(F.count("*").alias("weight"))
    return Dataset("shop", neurons, edges)


_DATASET = "SELECT o_custkey AS pre, 1000000 + l_suppkey AS post, l_returnflag AS region, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


@R.add(f"WITH e AS ({_DATASET}) SELECT id, region, CAST(sum(o) AS BIGINT) AS pre, CAST(sum(i) AS BIGINT) AS post FROM (SELECT pre AS id, region, weight AS o, 0 AS i FROM e UNION ALL SELECT post, region, 0, weight FROM e) GROUP BY 1, 2")
def dataset_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).region_counts()


@R.add("SELECT c_custkey AS id, c_mktsegment AS type, c_acctbal AS size FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND c_acctbal > 0 ORDER BY id LIMIT 200")
def dataset_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = _dataset(spark, sf_dir)
    shop.population = [F.col("type") == "BUILDING", F.col("size") > 9000]
    return shop.find([{"column": "size", "op": "gt", "value": 0}], limit=200)


@R.add(f"WITH e AS ({_DATASET}) SELECT post AS id, CAST(sum(weight) AS BIGINT) AS total FROM e GROUP BY 1")
def dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).query("SELECT post AS id, sum(weight) AS total FROM shop_edges GROUP BY post")


@R.add(likeness._PAIRS + """, m AS (SELECT row, col FROM p WHERE round(1 - dot / (sqrt(a2) * sqrt(b2)), 8) <= 0.7), x AS (SELECT row AS a, col AS b FROM m UNION ALL SELECT col, row FROM m),
q AS (WITH RECURSIVE r(id, root) AS (SELECT DISTINCT obs, obs FROM c UNION SELECT x.b, r.root FROM r JOIN x ON x.a = r.id WHERE r.root < x.b) SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT id, size FROM q JOIN (SELECT root, count(*) AS size FROM q GROUP BY 1) USING (root)
""")
def single_linkage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = likeness.vectors(spark, sf_dir)
    distance = similarity.similarity(cells, "cosine", "distance").withColumn("value", F.round("value", 8))
    return similarity.single_linkage_clusters(distance, 0.7, cells.select(F.col("obs").alias("id")).distinct()).select("id", "size")


@R.add()
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the paths of the nodes whose id 50 divides."""
    e = checkpointed(graphs.following(spark, sf_dir).where("source <> target"))
    return network.betweenness(e, graphs.fiftieth(e)).withColumn("betweenness", F.round("betweenness", 6))


@R.add()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.communities(graphs.following(spark, sf_dir))


@R.add("""
WITH s AS (SELECT o_custkey AS pre, 1000000 + l_suppkey AS post, l_discount AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT neuron, partner, polarity, count(*) AS n FROM (SELECT pre AS neuron, post AS partner, 'pre' AS polarity FROM s WHERE confidence >= 0.02 AND pre IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  UNION ALL SELECT post, pre, 'post' FROM s WHERE confidence >= 0.02 AND post IN (SELECT 1000000 + s_suppkey FROM supplier WHERE s_acctbal < 0)) GROUP BY 1, 2, 3
""")
def dataset_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = _dataset(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shop.synapses = lines.select(F.col("o_custkey").alias("pre"), (F.col("l_suppkey") + graphs.BEYOND).alias("post"), F.col("l_discount").alias("confidence"))
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    owing = owing.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey") + graphs.BEYOND))
    return shop.synapses_of(owing, least=0.02).groupBy("neuron", "partner", "polarity").agg(F.count("*").alias("n"))


def brand_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart brands lie by the mean size and price of their parts."""
    parts = table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("id")).agg(F.avg("p_size").alias("x"), (F.avg("p_retailprice") / 50).alias("y"))
    pairs = parts.toDF("row", "ax", "ay").crossJoin(F.broadcast(parts.toDF("col", "bx", "by"))).where("row < col")  # a row a brand
    return pairs.select("row", "col", F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)).alias("value"))


_BRAND_PLACES = r"SELECT CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS id, avg(p_size) AS x, avg(p_retailprice) / 50 AS y FROM part GROUP BY 1"


@R.add(f"""
WITH RECURSIVE p AS ({_BRAND_PLACES}), d AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.id <> b.id),
r(k, groups, heights) AS (SELECT 0, (SELECT list([id] ORDER BY id) FROM p), CAST([] AS DOUBLE[])
  UNION ALL SELECT k + 1, list_append(list_filter(groups, lambda g: g <> best.g AND g <> best.h), list_sort(list_concat(best.g, best.h))), list_append(heights, best.v) FROM (
    SELECT k, groups, heights, (SELECT arg_min(struct_pack(g := g, h := h, v := v), v) FROM (SELECT g, h, (SELECT avg(d.d) FROM d WHERE list_contains(g, d.a) AND list_contains(h, d.b)) AS v
      FROM (SELECT unnest(r.groups) AS g) x, (SELECT unnest(r.groups) AS h) y WHERE g[1] < h[1]) z) AS best FROM r WHERE len(groups) > 1) w)
SELECT CAST(step - 1 AS BIGINT) AS step, round(heights[step], 6) AS height FROM (SELECT heights, unnest(range(1, len(heights) + 1)) AS step FROM r ORDER BY k DESC LIMIT (SELECT count(*) - 1 FROM p))
""")
def linkage_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.agglomerated(brand_distances(spark, sf_dir), "average").select("step", F.round("height", 6).alias("height"))


@R.add()
def linkage_ward_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    distances = brand_distances(spark, sf_dir)
    members = distances.select(F.explode(F.array("row", "col")).alias("id")).distinct()
    return linkage.cut_by_count(linkage.agglomerated(distances, "ward"), members, 6)
