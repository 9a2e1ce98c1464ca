"""Sources, geometry and streaming on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import lineage
from loomgraph.operators import geometry, network, similarity
from loomgraph.sources import tables
from loomgraph.sources.dataset import Dataset
from loomgraph.streaming import events


def test_delimited_text_is_inferred(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tflag\tn\tx\tcode\tbig\tname\tname\t\n720575940600000001\ttrue\t1\t1.5\t007\t9007199254740993\ta\tb\t\n2\tFALSE\t0\t3\t010\t5\t\tc\t \n")
    df = tables.read_delimited(spark, str(tmp_path / "t.tsv"), id_column="id")
    assert dict(df.dtypes) == {"neuronId": "string", "flag": "boolean", "n": "bigint", "x": "double", "code": "string", "big": "string", "name": "string", "name_2": "string", "col_9": "string"}
    rows = {r.neuronId: r for r in df.collect()}
    assert rows["2"].x == 3.0 and rows["2"].code == "010" and rows["2"].name is None and rows["2"].name_2 == "c"
    # Text stays as it is written, and a cell of blanks is text.
    assert rows["2"].col_9 == " " and rows["720575940600000001"].col_9 is None
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["flag"] == "boolean" and dict(df.dtypes)["big"] == "string"


def test_quoted_cells_keep_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note,n\n1,"a, ""b""\nsecond line",5\n2,plain, 7\n')
    got = tables.read_delimited(spark, str(tmp_path / "q.csv")).orderBy("id").collect()
    assert [(r.id, r.note, r.n) for r in got] == [(1, 'a, "b"\nsecond line', 5), (2, "plain", 7)]


def test_feather_is_read_by_batches(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"id": list(range(1000)), "t": [f"x{i}" for i in range(1000)]})
    with pa.ipc.new_file(str(tmp_path / "f.feather"), table.schema) as out:
        out.write_table(table, max_chunksize=100)
    df = tables.link(spark, str(tmp_path / "f.feather"), "feather")
    assert df.count() == 1000 and df.rdd.getNumPartitions() == 10 and df.where("id = 7").first().t == "x7"


def test_states_need_a_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, getCheckpointDir = "spark://far:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Elsewhere)


def test_tables_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "id long, t string, u string")
    info = {r.name: (r.type, r.example) for r in tables.table_info(df).collect()}
    assert info["t"] == ("string", "b")
    tables.export(df, str(tmp_path / "out"), "json", single=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert tables.joined_ids(spark.createDataFrame([(10,), (9,), (9,), (None,)], "id long"), "id") == "9, 10"
    got = {r.id: r.found for r in tables.parsed_ids(spark, "1; 7,\n1 and 2", df).collect()}
    assert got == {"1": True, "7": False, "2": True}
    df.write.parquet(str(tmp_path / "p"))
    file = tables.link(spark, str(tmp_path / "p"))
    assert tables.read_rows(file, ["t"], df.where("id = 2"), "id", "id").collect()[0].t == "b"
    assert tables.read_rows(file, ["t"], df.where("false"), "id", "id").count() == 0
    tags = spark.createDataFrame([(1, "cell_type", "A"), (1, "side", "L"), (2, "side", "R")], "id long, tag string, value string")
    assert {(r.id, r.type, r.side) for r in tables.tag_table(tags, "id", "tag", "value").collect()} == {(1, "A", "L"), (2, None, "R")}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).withColumn("w", F.lit("x")).write.parquet(str(tmp_path / "p"))
    plan = tables.read_rows(tables.link(spark, str(tmp_path / "p")).where("v > 50"), ["id"])._jdf.queryExecution().toString()
    assert "GreaterThan(v,50)" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_dataset(spark):
    neurons = spark.createDataFrame([(1, "A", "Traced"), (2, None, "Orphan"), (3, "B", None)], "id long, type string, status string")
    edges = spark.createDataFrame([(1, 2, "R1", 3), (1, 2, "R2", 1), (2, 3, "R1", 5)], "pre long, post long, region string, weight long")
    data = Dataset("toy", neurons, edges, spark.createDataFrame([(1, 2, 0.0), (2, 3, 1.0)], "pre long, post long, x double"))
    assert {(r.id, r.region): (r.pre, r.post) for r in data.region_counts().collect()}[2, "R1"] == (5, 3)
    data.population = [F.col("status") == "Traced", F.col("type").isNotNull()]
    assert [r.id for r in data.find([]).orderBy("id").collect()] == [1, 3]
    ids = spark.createDataFrame([(2,)], "id long")
    assert data.connections(ids, "inputs").count() == 2 and data.between(ids, None).count() == 1
    points = {(r.neuron, r.partner, r.polarity, r.x) for r in data.synapses_of(spark.createDataFrame([(2,)], "id long")).collect()}
    assert points == {(2, 1, "post", 0.0), (2, 3, "pre", 1.0)} and data.synapses_of(spark.createDataFrame([(2,)], "id long"), "pre").count() == 1
    assert data.query("SELECT count(*) AS n FROM toy_edges").first().n == 3
    assert {r.id: r.total for r in data.totals().collect()} == {2: 4, 3: 5}


def test_geometry(spark):
    points = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 10.0, 0.0, 0.0), ("b", 2, 1.0, 0.0, 0.0), ("b", 3, 0.0, 3.0, 4.0)], "id string, at long, x double, y double, z double")
    moved = geometry.affine(points, [[0, 1, 0, 5], [1, 0, 0, 0], [0, 0, 2, -1]]).where("at = 3").first()
    assert (moved.x, moved.y, moved.z) == (8.0, 0.0, 7.0)
    assert geometry.mirrored(points, "x", 1.0).where("at = 1").first().x == -8.0
    near = {(r.row, r.at, r.col): r.distance for r in geometry.within(points, points, 5.0).collect()}
    assert near["a", 0, "b"] == 1.0 and near["b", 3, "a"] == 5.0 and ("a", 1, "b") not in near
    share = {(r.row, r.col): r.share for r in geometry.close_share(points, points, 1.0).collect()}
    assert share["a", "b"] == 0.5
    assert {(r.row, r.col): r.value for r in geometry.centroid_distance(points, points).collect()}["a", "a"] == 0
    boxes = spark.createDataFrame([("r", -1.0, 2.0, -1.0, 1.0, -1.0, 1.0)], "roi string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    assert sorted(r.at for r in geometry.in_boxes(points, boxes, 0.7).collect()) == [0, 2]
    nodes = spark.createDataFrame([("n", 1, None, 0.0, 0.0, 0.0), ("n", 2, 1, 3.0, 4.0, 0.0), ("n", 3, 2, 3.0, 4.0, 1.0), ("n", 4, 2, 3.0, 4.0, -2.0)], "id string, node long, parent long, x double, y double, z double")
    one = geometry.cable(nodes).first()
    assert (one.n_nodes, one.cable, one.branch_points, one.end_points, one.roots) == (4, 8.0, 1, 2, 1)


def test_windows_over_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "a", 1.0) for i in range(0, 60, 7)], "id long, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    late = df.limit(1).withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    held = events.windowed(events.stream(spark, str(tmp_path / "in"), df.schema), "ts", "kind", "value", "20 minutes")
    query = held.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    stream = sorted((r.start, r.n) for r in spark.table("windows").collect())
    assert stream == sorted((r.start, r.n) for r in events.windowed(df.union(late), "ts", "kind", "value", "20 minutes").collect())
    assert events.sessions(df, "ts", "kind", "8 minutes").count() == 1 and events.sessions(df, "ts", "kind", "6 minutes").count() == df.count()


def test_betweenness_communities_and_cuts(spark):
    line = spark.createDataFrame([(i, i + 1, 1) for i in range(4)], "source long, target long, weight long")
    ids = spark.range(5)
    assert {r.id: r.betweenness for r in network.betweenness(line, ids).collect()} == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 0.0}
    cliques = spark.createDataFrame([(a + o, b + o, 1) for o in (0, 10) for a in range(5) for b in range(a)] + [(0, 10, 1)], "source long, target long, weight long")
    groups = {}
    for r in network.communities(cliques).collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    d = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.3), ("a", "c", 0.9), ("c", "d", 0.8)], "row string, col string, value double")
    assert sorted(r["size"] for r in similarity.single_linkage_clusters(d, 0.3).collect()) == [1, 3, 3, 3]


def test_the_entry_has_queries_and_sql(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["flagship_priority_revenue", "group_by_sum", "net_degrees"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, at)
    names = sorted(df.columns)
    held = con.execute(__spark_entry__.oracle_sql()[name])
    order = [d[0] for d in held.description]
    wanted = sorted(json.dumps([dict(zip(order, r))[c] for c in names], default=str) for r in held.fetchall())
    assert sorted(json.dumps([r[c] for c in names], default=str) for r in df.collect()) == wanted


def test_types_are_matched_across_datasets(spark):
    rows = [("a", 1, "LC4"), ("b", 7, "LC4"), ("b", 8, "lc-four"), ("b", 7, "lc-four"), ("a", 2, "X"), ("a", 3, " ")]
    labels, report = network.match_types(spark.createDataFrame(rows, "dataset string, id long, label string"), 2)
    assert {(r.dataset, r.id): (r.type, r.matched) for r in labels.collect()} == {("a", 1): ("LC4", True), ("b", 7): ("LC4", True), ("b", 8): ("LC4", True), ("a", 2): ("X", False)}
    assert {(r.type, r.dataset): r.n_neurons for r in report.collect()} == {("LC4", "a"): 1, ("LC4", "b"): 2, ("X", "a"): 1}
