"""Row, join, aggregate, chart, trace, network and similarity operators on small tables with known answers."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lineage
from loomgraph.functions.columns import free_name, natural_key
from loomgraph.functions.lineage import percentiles
from loomgraph.operators import aggregates, charts, joins, network, rows, similarity, traces
from loomgraph.plans.registry import TASK_BYTES, Registry


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([(1, "DNp02", 30), (1, "DNp02", 10), (1, "PVLP002", 5), (2, "DNp02", 20), (2, "PVLP002", 15), (3, "PLP003", 2)], "id long, partner string, weight long")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_rename_resolves_clashes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rows.rename_columns(df, {"a": "b", "b": "a"}).columns == ["b", "a", "c"]
    assert rows.rename_columns(df, {"a": "c"}).columns == ["c", "b", "c_2"]
    assert free_name("x", ["x", "x_2"]) == "x_3"


def test_sort_puts_missing_last_and_numbers_in_order(spark):
    df = spark.createDataFrame([("a10", 5), ("a2", None), ("A1", 9), (None, 1)], "t string, w int")
    assert [r.t for r in rows.sort(df, "t").collect()] == ["A1", "a2", "a10", None]
    assert [r.w for r in rows.sort(df, "w").collect()] == [1, 5, 9, None]
    assert [r.w for r in rows.sort(df, "w", descending=True, limit=2).collect()] == [9, 5]
    assert df.select(natural_key(F.lit("b007x12")).alias("k")).first().k == "b" + "7".zfill(20) + "x" + "12".zfill(20)


def test_numbering_and_samples(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(values(rows.numbered(df, ("id",)), "id", "row_at")) == [(i, i) for i in range(1000)]
    assert sorted(r.id for r in rows.sample(df, "stride", ("id",), step=300).collect()) == [0, 300, 600, 900]
    assert sorted(r.id for r in rows.sample(df, "tail", ("id",), count=2).collect()) == [998, 999]
    a = {r.id for r in rows.sample(df, "random", ("id",), count=50, seed=1).collect()}
    assert len(a) == 50 and a == {r.id for r in rows.sample(df.repartition(3), "random", ("id",), count=50, seed=1).collect()}


def test_dedupe(links):
    assert sorted(values(rows.dedupe(links, ["id"], "first", ("weight",)), "id", "weight")) == [(1, 5), (2, 15), (3, 2)]
    assert sorted(values(rows.dedupe(links, ["id"], "last", ("weight",)), "id", "weight")) == [(1, 30), (2, 20), (3, 2)]
    assert values(rows.dedupe(links, ["id"], "none", ("weight",)), "id") == [(3,)]


def test_combine_relabel_edit_qualify(spark):
    df = spark.createDataFrame([(1, " ", "x", 5), (2, None, None, 6), (3, "a", "b", None)], "id int, p string, q string, n int")
    assert values(rows.combine_columns(df, ["p", "q", "n"], "p", "from").orderBy("id"), "p_2", "from") == [("x", "q"), ("6", "n"), ("a", "p")]
    names = spark.createDataFrame([("a", "A"), ("a", "Z"), (None, "none"), (" ", "blank")], "k string, v string")
    assert values(rows.relabel(df, names, "p", "k", "v", "keep").orderBy("id"), "p") == [("blank",), ("none",), ("A",)]
    assert values(rows.relabel(df, names, "q", "k", "v", "null").orderBy("id"), "q") == [(None,), ("none",), (None,)]
    assert values(rows.relabel(df, names, "q", "k", "v", "drop"), "id") == [(2,)]
    edited = rows.edit_table(df, [{"where": [{"column": "n", "op": "ge", "value": 6}], "column": "n", "value": 1.5}, {"where": [{"column": "n", "op": "lt", "value": 2}], "column": "new", "value": "low"}])
    assert values(edited.orderBy("id"), "n", "new") == [(5.0, None), (1.5, "low"), (None, None)]
    assert values(rows.qualify_ids(df, "id", "d").orderBy("id"), "id") == [("d:1",), ("d:2",), ("d:3",)]


def test_unpivot_and_stack(spark):
    wide = spark.createDataFrame([(1, "LC4", 40, 0), (2, "LC6", None, 7)], "id long, type string, a long, b long")
    assert sorted(values(rows.unpivot(wide, ["a", "b"], ["id"], drop_empty=True), "id", "name", "value")) == [(1, "a", 40), (1, "b", 0), (2, "b", 7)]
    other = spark.createDataFrame([(0.5, "z")], "a double, c string")
    stacked = rows.stack({"one": wide, "two": other}, "src")
    assert stacked.columns == ["id", "type", "a", "b", "src", "c"]
    assert dict(stacked.dtypes)["a"] == "double" and stacked.count() == 3
    with pytest.raises(ValueError):
        rows.stack({"one": wide, "two": spark.createDataFrame([("x",)], "a string")})


@pytest.fixture(scope="module")
def wider(spark):
    return spark.createDataFrame([(2, "R", 1), (9, "L", 2), (1, "L", 3), (1, "R", 4), (None, "N", 5)], "id long, side string, at int")


def test_joins_never_multiply(spark, wider):
    left = spark.createDataFrame([(1, "LC4"), (2, "LC6"), (2, "again"), (None, "x")], "id long, type string")
    side = wider.select("id", "side", "at")
    assert sorted(values(joins.join(left, side, "id", "id", "left", order=("at",)), "type", "side"), key=str) == [("LC4", "L"), ("LC6", "R"), ("again", "R"), ("x", None)]
    assert sorted(values(joins.join(left, side, "id", "id", "inner", order=("at",)), "type", "side")) == [("LC4", "L"), ("LC6", "R"), ("again", "R")]
    outer = joins.join(left, side, "id", "id", "outer", order=("at",))
    assert (9, None, "L") in values(outer, "id", "type", "side") and outer.count() == 5
    right = values(joins.join(left, side, "id", "id", "right", order=("type",)), "id", "type", "side")
    assert sorted(right, key=str) == sorted([(2, "LC6", "R"), (9, None, "L"), (1, "LC4", "L"), (1, "LC4", "R"), (None, None, "N")], key=str)
    as_text = joins.join(left, side.select(F.col("id").cast("string").alias("id"), F.col("side").alias("type")), "id", "id", "outer", order=("type",))
    assert as_text.columns == ["id", "type", "type_2"] and dict(as_text.dtypes)["id"] == "string"


def test_overlay_prefers_the_right(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, l string, n int")
    b = spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "id int, l string")
    assert sorted(values(joins.overlay(a, b, "id"), "id", "l", "n")) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]


def test_group_by_rules(spark):
    ragged = spark.createDataFrame([("a", 10.0, "x"), ("a", None, None), ("a", 20.0, "x"), ("b", None, ""), ("b", None, None), (None, 1.0, "q")], "k string, w double, t string")
    assert values(aggregates.group_by(ragged, ["k"], "sum", ["w", "w"]).orderBy("k"), "k", "n", "sum_w") == [(None, 1, 1.0), ("a", 3, 30.0), ("b", 2, 0.0)]
    assert values(aggregates.group_by(ragged, ["k"], "mean", ["w"]).orderBy("k"), "mean_w") == [(1.0,), (15.0,), (None,)]
    assert values(aggregates.group_by(ragged, ["k"], "countDistinct", ["t"]).orderBy("k"), "countDistinct_t") == [(1,), (1,), (1,)]
    assert values(aggregates.group_by(ragged, ["k"], "join", ["t"]).orderBy("k"), "join_t") == [("q",), ("x",), (None,)]
    assert aggregates.group_by(ragged, ["k"], "count").columns == ["k", "n"]
    tags = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), ("a", "z", 3)], "k string, t string, at int")
    assert values(aggregates.group_by(tags, ["k"], "join", ["t"], order=F.col("at")), "join_t") == [("z; b",)]


def test_pivot(links):
    out = aggregates.pivot(links, "id", "partner", "sum", "weight").orderBy("id")
    assert out.columns == ["id", "DNp02", "PLP003", "PVLP002"]
    assert [tuple(r) for r in out.collect()] == [("1", 40, 0, 5), ("2", 20, 0, 15), ("3", 0, 2, 0)]
    with pytest.raises(ValueError):
        aggregates.pivot(links, "id", "id", "count")


def test_matrices(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0), ("b", "y", 0.0), ("c", "x", -2.0), ("c", "y", 1.0), ("c", "a", float("nan"))], "row string, col string, value double")
    one = {r.label: r for r in aggregates.reduce_matrix(m).collect()}
    assert (one["a"].n, one["a"]["sum"], one["a"].median, one["c"].n, one["c"].min) == (2, 4.0, 2.0, 2, -2.0)
    share = {(r.row, r.col): r.value for r in aggregates.normalize(m.where("col <> 'a'"), "row").collect()}
    assert share["a", "y"] == 0.75 and share["b", "x"] == 0 and math.isnan(share["c", "y"])
    top = {(r.row, r.col): r.value for r in aggregates.normalize(m.where("col <> 'a'"), "max").collect()}
    assert top["a", "y"] == 1.0
    assert {r.label: r.n for r in aggregates.reduce_matrix(m, "columns", ("n",)).collect()}["x"] == 3


def test_describe(spark):
    df = spark.createDataFrame([(1, " ", 4.0), (2, "b", None), (2, None, 0.0)], "id long, t string, x double")
    out = {r["column"]: r for r in aggregates.describe(df, "id").collect()}
    assert (out["t"].non_nulls, out["t"].nulls, out["t"].unique) == (1, 2, 1)
    assert (out["x"].non_zero, out["x"].q1, out["x"].max, out["x"]["mean"]) == (1, 1.0, 4.0, 2.0)
    assert out["id"].unique == 2 and out["id"].min is None


def test_charts(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(100)] + [("h", 5.0), (None, 500.0)], "g string, v double")
    bins = charts.histogram(df.where("g = 'g'"), "v", bins=4).orderBy("bin")
    assert values(bins, "n") == [(25,)] * 4
    assert values(charts.histogram(df.where("g = 'h'"), "v"), "n") == [(1,)]
    assert charts.histogram(df.where("false"), "v").count() == 0
    box = {r.group: r for r in charts.box_summary(df, "v", "g").collect()}
    assert box["g"].median == 49.5 and box["g"].outliers == 0 and box[charts.NONE].n == 1
    ranked = charts.rank_share(spark.createDataFrame([(1, 6), (2, 3), (3, 1)], "id int, v int"), "v", ("id",), flag=F.col("id") == 2).orderBy("rank")
    assert [round(r.share, 3) for r in ranked.collect()] == [0.857, 0.857, 1.0]
    assert charts.rank_share(spark.createDataFrame([(1, -6), (2, 3)], "id int, v int"), "v", ("id",)).where("share is not null").count() == 0
    pie = charts.pie(spark.createDataFrame([(str(i), 10 - i) for i in range(10)], "c string, v int"), "c", "v", most=3)
    assert {r.c: r.amount for r in pie.collect()} == {"0": 10, "1": 9, "Other": 36}
    whole = sum(r.density for r in charts.density(df.where("g = 'g'"), "v", "g").collect()) * 99 / 64
    assert 0.8 < whole < 1.05


def test_percentiles_are_exact_by_group(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    groups = {"a": draw.normal(size=101).tolist(), "b": [1.0, 1.0, 2.0, float("nan")], None: [5.0], "c": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    got = {r.g: r for r in percentiles(df, "v", [0.05, 0.5, 1.0], ["g"]).collect()}
    assert set(got) == {"a", "b", None} and got[None].q == [5.0] * 3
    for g in ("a", "b"):
        held = [v for v in groups[g] if v == v]
        assert got[g].n == len(held) and got[g].q == pytest.approx(np.quantile(held, [0.05, 0.5, 1.0]).tolist())
    assert percentiles(df.where("false"), "v", [0.5]).count() == 0


def test_groups_are_ranked_without_missing_values(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, None), ("b", 4, 5.0), (None, 5, 2.0), (None, 6, float("nan"))], "g string, id int, v double")
    got = {r.id: (r.rank, r.share) for r in charts.rank_share(df, "v", ("id",), by=("g",)).collect()}
    assert got == {1: (1, 0.75), 2: (2, 1.0), 4: (1, 1.0), 5: (1, 1.0)}


def test_no_task_holds_a_group(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "cast(id AS double) AS v")
    for plan in (charts.decimated(df, "id", "v", "g", 5), rows.dedupe(df, ["g"], "none", ("id",))):
        text = plan._jdf.queryExecution().toString()
        assert "Window" not in text and "Expand" not in text and "CartesianProduct" not in text
    for plan in (charts.rank_share(df, "v", ("id",), by=("g",)), traces.interpolated(df.selectExpr("g AS series", "cast(id AS double) AS t", "v AS value"), df.selectExpr("g AS series", "cast(id AS double) AS t"))):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "windowspecdefinition(g" not in text and "windowspecdefinition(series" not in text


def test_select_one(links):
    assert values(rows.select_one(links, 1, "id", ("id", "weight")), "id") == [(2,), (2,)]
    assert rows.select_one(links, 9, "id", ("id",)).count() == 0


def test_traces(spark):
    held = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 10.0), ("a", 20.0, 0.0)], "series string, t double, value double")
    grid = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 5.0, 10.0, 15.0, 25.0)], "series string, t double")
    assert values(traces.interpolated(held, grid).orderBy("t"), "value") == [(None,), (0.0,), (5.0,), (10.0,), (5.0,), (None,)]
    assert values(traces.pooled(held, 20.0).orderBy("t"), "t", "value") == [(0.0, 5.0), (20.0, 0.0)]


@pytest.fixture(scope="module")
def square(spark):
    """1 -> 2 -> 3 -> 4 -> 1, a chord 1 -> 3, and 8 -> 9."""
    return spark.createDataFrame([(1, 2, 5), (2, 3, 4), (3, 4, 3), (4, 1, 2), (1, 3, 1), (8, 9, 7)], "source long, target long, weight long")


def test_network(spark, square):
    built = network.build(square.union(square.limit(1)), "source", "target", "weight")
    assert {(r.source, r.target): (r.weight, r.edges) for r in built.collect()}[1, 2] in ((10, 2), (5, 1)) and built.count() == 6
    tri = {r.id: (r.degree, r.triangles, r.clustering) for r in network.triangles(square).collect()}
    assert tri[1] == (3, 2, pytest.approx(2 / 3)) and tri[8] == (1, 0, None)
    comp = {r.id: (r.component, r["size"]) for r in network.components(square).collect()}
    assert comp[4] == (1, 4) and comp[9] == (2, 2)
    core = {r.id: r.coreness for r in network.coreness(square).collect()}
    assert core == {1: 2, 2: 2, 3: 2, 4: 2, 8: 1, 9: 1}
    seed = spark.createDataFrame([(1,)], "id long")
    assert {r.id: r.hop for r in network.reach(square, seed, 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r.id for r in network.reach(square, seed, 1, "upstream").collect()} == {1, 4}
    assert network.filtered(square, seed, "component").count() == 5
    conn = {(r.source, r.target): (r.hop, r.direction) for r in network.connectivity(square, seed, 2, "both").collect()}
    assert conn[1, 2] == (1, "outputs") and conn[4, 1] == (1, "inputs") and conn[2, 3][0] == 2
    norm = {(r.source, r.target): r.weight_norm for r in network.connectivity(square, seed, 1, "outputs", normalize_by="postsynaptic").collect()}
    assert norm[1, 3] == 0.2
    target = spark.createDataFrame([(4,)], "id long")
    best = network.paths(square, seed, target, 3, 5).orderBy("rank").collect()
    assert [(r.path, r.hops, r.bottleneck) for r in best] == [([1, 2, 3, 4], 3, 3.0), ([1, 3, 4], 2, 1.0)]
    flow = {r.id: r.influence for r in network.influence(square, seed, 2).collect()}
    assert flow[3] == pytest.approx(0.2 + 0.8) and flow[1] == 1.0
    rank = {r.id: r.pagerank for r in network.pagerank(square, tolerance=1e-10).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank[3] > rank[2]
    assert network.motif(square, [("a", "b"), ("b", "c"), ("a", "c")]).count() == 1
    assert network.motif(square, [("a", "b")], [("b", "a")]).count() == 6
    close = {r.id: r.closeness for r in network.closeness(square, seed, 5).collect()}
    assert close[1] == 1.0
    vec = {r.id: r.eigenvector for r in network.eigenvector(square.where("source < 8")).collect()}
    assert sum(v * v for v in vec.values()) == pytest.approx(1)
    held = {(1, 2): 5, (2, 3): 4, (3, 4): 3, (4, 1): 2, (1, 3): 1}
    pushed = {x: vec[x] + sum(w * vec[b if a == x else a] for (a, b), w in held.items() if x in (a, b)) for x in vec}
    assert all(pushed[x] / vec[x] == pytest.approx(pushed[1] / vec[1], rel=1e-3) for x in vec)
    with pytest.raises(ValueError):
        network.motif(square, [("a", "b"), ("c", "d")])


def test_similarity(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 2)
    table = {"a": {1: 3.0, 2: 4.0}, "b": {1: 3.0, 2: 4.0}, "c": {1: 1.0, 3: 2.0}, "d": {4: 1.0}, "e": {1: 2.0, 2: 2.0, 3: 1.0}}
    long = spark.createDataFrame([(o, f, v) for o, fs in table.items() for f, v in fs.items()], "obs string, feature long, value double")
    features = [1, 2, 3, 4]
    dense = {o: [fs.get(f, 0.0) for f in features] for o, fs in table.items()}

    def pearson(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))

    truth = {
        "cosine": lambda x, y: sum(a * b for a, b in zip(x, y)) / math.hypot(*x) / math.hypot(*y),
        "jaccard": lambda x, y: sum(a > 0 and b > 0 for a, b in zip(x, y)) / sum(a > 0 or b > 0 for a, b in zip(x, y)),
        "jaccardWeighted": lambda x, y: sum(map(min, x, y)) / sum(map(max, x, y)),
        "euclidean": math.dist,
        "pearson": pearson,
    }
    for metric, f in truth.items():
        got = {(r.row, r.col): r.value for r in similarity.similarity(long, metric).collect()}
        assert set(got) == {(x, y) for x in table for y in table if x < y and set(table[x]) & set(table[y])}
        for (x, y), v in got.items():
            assert v == pytest.approx(f(dense[x], dense[y]), abs=1e-7)
    with pytest.raises(ValueError):
        similarity.similarity(long.withColumn("value", -F.col("value")), "jaccardWeighted")
    scores = similarity.both_halves(similarity.similarity(long, "cosine"))
    assert values(similarity.matches(scores, "top", 1).where("query = 'a'"), "target", "rank") == [("b", 1)]
    assert similarity.matches(scores, "above", threshold=0.99).count() == 2
    assert similarity.symmetrised(scores, "max").count() == scores.count()


def test_nearest_vectors_are_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    got = similarity.nearest_vectors(df, df.where("id < 7"), "id", "v", 4, block=3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    for q in range(7):
        assert [r.target for r in got.where(F.col("query") == q).orderBy("rank").collect()] == np.argsort(-sim[q])[:4].tolist()


def test_domain_edges(spark):
    points = spark.createDataFrame([("n", "p", "pre"), ("n", "p", "post"), ("n", " ", "pre"), (None, "p", "pre")], "neuron string, partner string, polarity string")
    assert sorted(values(joins.synapse_edges(points), "pre", "post", "weight")) == [("n", "p", 1), ("p", "n", 1)]
    edges = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0), (4, 1, 2.0)], "pre long, post long, weight double")
    labels = spark.createDataFrame([(2, "X"), (3, ""), (4, "X")], "id long, label string")
    ids = spark.createDataFrame([(1,)], "id long")
    got = values(joins.partner_vectors(edges, ids, labels, weighting="fraction"), "feature", "value")
    assert sorted(got) == [("in:X", 1.0), ("out:3", 0.25), ("out:X", 0.75)]
    assert len(values(joins.partner_vectors(edges, ids, labels, untyped="drop"), "feature")) == 2
    a, b = labels.where("id < 3"), labels
    out = joins.compare_connectivity({"a": edges, "b": edges.withColumn("pre", F.lit(2)).withColumn("post", F.lit(4))}, {"a": a, "b": b.where("label <> ''")})
    assert values(out, "pre_label", "post_label", "weight_a", "weight_b", "present_a") == [("X", "X", 0.0, 6.0, True)]


def test_coreness_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1, 1) for i in range(130)]
    hub = [(1000, 1001 + i, 1) for i in range(60)] + [(1001, 1002, 1)]
    got = {r.id: r.coreness for r in network.coreness(spark.createDataFrame(path + hub, "source long, target long, weight long")).collect()}
    assert all(got[i] == 1 for i in range(131)) and got[1000] == got[1001] == got[1002] == 2 and got[1003] == 1


def test_summary_of_a_network(spark, square):
    more = square.union(spark.createDataFrame([(2, 2, 9), (1, 2, 5)], "source long, target long, weight long"))
    members = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 8, 9, 77)], "id long")
    one = network.summary(more, members).first()
    assert (one.nodes, one.links, one.self_loops, one.parallel_links, one.isolated) == (7, 8, 1, 1, 1)
    assert (one.components, one.largest_component, one.reciprocity, one.max_degree) == (3, 4, 0.0, 5)
    assert one.density == pytest.approx(6 / 42) and one.transitivity == pytest.approx(6 / 8) and one.median_weight == 4.5 and one.total_weight == 36.0
    degrees = {1: 3, 2: 2, 3: 3, 4: 2, 8: 1, 9: 1}
    ends = [(degrees[a], degrees[b]) for a, b in ((1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (8, 9))]
    ends += [(b, a) for a, b in ends]
    m = sum(x for x, _ in ends) / len(ends)
    assert one.assortativity == pytest.approx((sum(x * y for x, y in ends) / len(ends) - m * m) / (sum(x * x for x, _ in ends) / len(ends) - m * m))
    assert network.summary(more, directed=False).first().reciprocity is None
    empty = network.summary(square.where("false")).first()
    assert (empty.nodes, empty.links, empty.density, empty.assortativity) == (0, 0, None, None)


def test_connection_compartments(spark):
    edges = spark.createDataFrame([(1, 2, 9), (3, 4, 1)], "preId long, postId long, weight long")
    ends = [("axon", "dendrite"), ("axon", "dendrite"), ("axon", "axon"), ("linker", "axon"), ("linker", None), ("dendrite", "soma"), ("dendrite", "dendrite")]
    synapses = spark.createDataFrame([(1, 2, a, b) for a, b in ends] + [(5, 6, "axon", "axon")], "pre long, post long, pre_compartment string, post_compartment string")
    wide = {r.preId: r for r in joins.connection_compartments(edges, synapses).collect()}
    one = wide[1]
    assert (one.weightAxonDendrite, one.weightAxonAxon, one.weightDendriteAxon, one.weightDendriteDendrite, one.weightLinker, one.weightUnsplit, one.synapses) == (2, 1, 0, 1, 1, 2, 7)
    assert one.weight == 9 and wide[3].synapses == 0 and len(wide) == 2
    long = joins.connection_compartments(edges, synapses, layout="long")
    assert long.columns == ["preId", "postId", "weight", "connection"] and long.count() == 12
    assert {r.connection: r.weight for r in long.where("preId = 1").collect()}["axo-dendritic"] == 2


def test_components_go_on_with_fewer_edges_each_round(spark, monkeypatch):
    draw, n = random.Random(5), 600
    ids = draw.sample(range(10_000), n)
    chain = [(ids[i], ids[i + 1]) for i in range(n - 1) if i % 200 != 199] + [(20_000, k) for k in range(20_001, 20_040)] + [(30_000, 30_000), (30_001, 30_000), (40_000, 40_000)]
    held, kept = [], network.measured
    monkeypatch.setattr(network, "measured", lambda df, **numbers: (out := kept(df, **numbers), held.append(out[1]["n"]))[0])
    got = {r.id: (r.component, r["size"]) for r in network.components(spark.createDataFrame(chain, "source long, target long")).collect()}
    groups = sorted([ids[:200], ids[200:400], ids[400:], list(range(20_000, 20_040)), [30_000, 30_001], [40_000]], key=lambda g: (-len(g), min(g)))
    assert got == {i: (k, len(g)) for k, g in enumerate(groups, 1) for i in g}
    assert held[0] == len({(min(e), max(e)) for e in chain if e[0] != e[1]}) and sum(held) < 4 * held[0] and len(held) < 30


def test_compartments_count_synapses_without_looking_for_their_edge(spark):
    edges = spark.range(50).select(F.col("id").alias("preId"), (F.col("id") + 100).alias("postId"), F.lit(1).alias("weight"))
    synapses = spark.range(600).select((F.col("id") % 60).alias("pre"), (F.col("id") % 60 + 100).alias("post"), F.lit("axon").alias("pre_compartment"), F.lit("axon").alias("post_compartment"))
    got = joins.connection_compartments(edges, synapses)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join") == 1
    assert [(r.n, r.m) for r in got.groupBy("weightAxonAxon").agg(F.count("*").alias("n"), F.max("synapses").alias("m")).collect()] == [(50, 10)]


def test_registered_queries_bound_what_a_task_reads(spark):
    held, (key, size) = Registry(), TASK_BYTES

    @held.add()
    def numbers(spark, sf_dir):
        return spark.range(3)

    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert held.queries["numbers"](spark, "").count() == 3 and spark.conf.get(key) == size
        spark.conf.set(key, "1m")
        held.queries["numbers"](spark, "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("few", [0, 20_000])
def test_percentiles_by_window_and_by_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(lineage, "FEW_VALUES", few)
    rows = [(k % 3, float((k * 37) % 50)) for k in range(200)] + [(7, None), (8, float("nan")), (9, 4.0)]
    got = {r.g: (r.n, list(r.q)) for r in lineage.percentiles(spark.createDataFrame(rows, "g long, v double"), "v", [0.25, 0.5, 1.0], ["g"]).collect()}
    held = {g: sorted(v for h, v in rows if h == g) for g in (0, 1, 2, 9)}
    assert got == {g: (len(v), pytest.approx([float(x) for x in np.percentile(v, [25, 50, 100])])) for g, v in held.items()}


def test_matches_of_columns(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0), ("b", "y", 1.0)], "row string, col string, value double")
    got = {(r.query, r.target) for r in similarity.matches(scores, "top", 1, axis="column").collect()}
    assert got == {("x", "b"), ("y", "a")}


def test_similarity_moves_cells_and_not_products(spark, monkeypatch):
    rows = [(o, f, float((o * f) % 7 + 1)) for o in range(40) for f in range(30) if (o + f) % 3]
    long = spark.createDataFrame(rows, "obs int, feature int, value double")
    want = {(r.row, r.col): round(r.value, 9) for r in similarity.similarity(long, "cosine").collect()}
    plan = similarity.similarity(long, "cosine")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert above.count("Exchange hashpartitioning") == 1  # the dealing of cells to pairs of blocks; their sums stay there
    monkeypatch.setattr(similarity, "CHUNK", 7)
    assert {(r.row, r.col): round(r.value, 9) for r in similarity.similarity(long, "cosine").collect()} == want
    monkeypatch.setattr(similarity, "MOST_CELLS", 20)
    assert {(r.row, r.col): round(r.value, 9) for r in similarity.similarity(long, "cosine").collect()} == want
    both = similarity.both_halves(similarity.similarity(long, "cosine"))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_products_are_no_rows(spark, monkeypatch):
    """Sums of pairs are made in a task: nothing in the plan explodes cells by cells, and the tasks' rows are cells and pairs."""
    monkeypatch.setattr(similarity, "CHUNK", 8)
    rows = [(o, f if f else None, None if o == f else float((o * f) % 7)) for o in range(30) for f in range(40) if (o + f) % 3]
    long = spark.createDataFrame(rows, "obs int, feature int, value double")
    out = similarity.similarity(long, "cosine")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Aggregate" not in plan and "MapInArrow" in plan
    held = {(o, f): v for o, f, v in rows if f is not None}
    norm = {o: sum(v * v for x, _, v in rows if x == o and v) for o in range(30)}
    for how, want in (("cosine", lambda a, b, v: v[0] / math.sqrt(norm[a] * norm[b]) if norm[a] * norm[b] else 0), ("euclidean", lambda a, b, v: math.sqrt(max(0, norm[a] + norm[b] - 2 * v[0])))):
        got = {(r.row, r.col): r.value for r in similarity.similarity(long, how).collect()}
        sums = {}
        for (a, f), v in held.items():
            for b in range(a + 1, 30):
                if (b, f) in held:
                    sums.setdefault((a, b), [0.0])[0] += (v or 0) * (held[b, f] or 0)
        assert got == {(a, b): pytest.approx(want(a, b, v), abs=1e-6) for (a, b), v in sums.items()}, how


def ring_of_fans(n, leaves):
    """A ring of n nodes, each with leaves: 100 * n + k is a leaf of n."""
    return [(i, (i + 1) % n, 1) for i in range(n)] + [(i, 100 * (i + 1) + k, 1) for i in range(n) for k in range(leaves)]


def distances(rows):
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        far, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in sorted(near[x]) if far.setdefault(y, far[x] + 1) == far[x] + 1 and y != s]
            front = list(dict.fromkeys(front))
        out[s] = far
    return out


def rows_written(monkeypatch):
    """How many rows each state has that a round of the network operators writes."""
    written, whole = [], network.measured

    def measured(df, **numbers):
        state, seen = whole(df, **numbers)
        written.append(state.count())
        return state, seen

    monkeypatch.setattr(network, "measured", measured)
    return written


def test_closeness_of_more_sources_than_a_word_has_bits(spark, monkeypatch):
    rows = ring_of_fans(5, 14)
    far = distances(rows)
    written = rows_written(monkeypatch)
    edges, ids = spark.createDataFrame(rows, "source int, target int, weight int"), spark.createDataFrame([(i,) for i in [*far, 5000]], "id int")
    want = {s: [d for d in far[s].values() if 0 < d <= 3] for s in far}
    got = {r.id: (r.reached, round(r.closeness, 9)) for r in network.closeness(edges, ids, 3).collect()}
    assert got == {s: (len(d), round(len(d) / sum(d), 9)) for s, d in want.items()}
    assert written and max(written) <= 2 * (len(far) + 1)  # a row a node and 64 sources


def test_betweenness_of_more_sources_than_lanes(spark, monkeypatch):
    rows = ring_of_fans(5, 8)
    far, want = distances(rows), {}
    written = rows_written(monkeypatch)
    edges, ids = spark.createDataFrame(rows, "source int, target int, weight int"), spark.createDataFrame([(i,) for i in distances(rows)], "id int")
    for s in far:
        for t in far[s]:
            for v in far[s]:
                if v not in (s, t) and far[s][v] + far[v][t] == far[s][t]:  # an odd ring has one shortest way each
                    want[v] = want.get(v, 0) + 1
    got = {r.id: r.betweenness for r in network.betweenness(edges, ids).collect()}
    assert got == {v: pytest.approx(want.get(v, 0) / 2) for v in far}
    assert written and max(written) <= 2 * len(far)  # a row a node and LANES sources


def test_rows_without_a_supervoxel_are_spread_over_tasks(spark):
    df = spark.range(4000).selectExpr("id", "id % 7 AS owner", "case when id % 2 = 0 then id end AS sv")
    lookup = spark.range(0, 4000, 4).selectExpr("id AS supervoxel", "id + 10000 AS new")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = joins.update_ids_by_supervoxel(df, lookup, "owner", "sv")
        sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        got = {r.id: r.owner for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i + 10000 if i % 4 == 0 else i % 7 for i in range(4000)}
    assert max(sizes) < 1500  # a quarter of the rows and a little more, not all those without one


def test_nearest_vectors_of_a_long_batch_take_the_memory_of_a_slice():
    """Whole batches against a block of queries took memory by their rows; ties at the edge of a slice go to the lesser id."""
    rng = np.random.default_rng(5)
    ids, x = rng.permutation(20_000), rng.integers(-2, 3, (20_000, 8)).astype(float)
    best = similarity.Best(ids[:100], x[:100], 5)
    tracemalloc.start()
    for at in range(0, len(ids), similarity.SLICE):
        best.meet(ids[at : at + similarity.SLICE], x[at : at + similarity.SLICE])
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()
    q, t, s = best.told()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in range(100):
        score = u[i] @ u.T
        score[i] = -np.inf
        assert np.allclose(np.sort(s[q == ids[i]])[::-1], np.sort(score)[::-1][:5]) and ids[i] not in t[q == ids[i]]


@pytest.fixture
def several_components(spark):
    """A ring with fans, a random graph, a chain and many pairs, as edges; and all distances."""
    draw = random.Random(3)
    rows = [(a, b, 1) for a, b, *_ in ring_of_fans(5, 8)]
    rows += [(20_000 + draw.randrange(60), 20_000 + draw.randrange(60), 1) for _ in range(150)] + [(30_000 + i, 30_001 + i, 1) for i in range(12)] + [(40_000 + 2 * i, 40_001 + 2 * i, 1) for i in range(90)]
    rows = [r for r in rows if r[0] != r[1]]
    return spark.createDataFrame(rows, "source long, target long, weight long"), distances(rows)


@pytest.mark.parametrize("most", [1 << 30, 128, 1])
def test_walks_in_tasks_and_by_joins(spark, several_components, monkeypatch, most):
    """All components in one bundle; some in bundles, the largest by joins; all by joins, in turns."""
    edges, far = several_components
    monkeypatch.setattr(network.walks, "MOST_LINKS", most)
    monkeypatch.setattr(network, "AT_ONCE", 400)
    want = {s: [d for d in far[s].values() if 0 < d <= 5] for s in far}
    got = {r.id: (r.reached, round(r.closeness, 9)) for r in network.closeness(edges, network.nodes(edges), 5).collect()}
    assert got == {s: (len(d), round(len(d) / sum(d), 9)) for s, d in want.items()}
    monkeypatch.setattr(network, "AT_ONCE", 20_000)
    ids = network.nodes(edges).where("id % 3 = 0")
    chosen, share = [s for s in far if s % 3 == 0], {}
    links = {}
    for r in edges.collect():
        links.setdefault(r.source, set()).add(r.target)
        links.setdefault(r.target, set()).add(r.source)
    for s in chosen:
        order = sorted(far[s], key=far[s].get)
        paths, gain = {s: 1}, {}
        for v in order[1:]:
            paths[v] = sum(paths[u] for u in links[v] if far[s][u] == far[s][v] - 1)
        for v in reversed(order[1:]):
            gain[v] = sum(paths[v] / paths[u] * (1 + gain[u]) for u in links[v] if far[s][u] == far[s][v] + 1)
            share[v] = share.get(v, 0) + gain[v]
    got = {r.id: r.betweenness for r in network.betweenness(edges, ids).collect()}
    assert got == {v: pytest.approx(share.get(v, 0) * len(far) / len(chosen) / 2) for v in far}


def test_bits_are_counted_by_lane():
    rows = np.random.default_rng(1).integers(0, 1 << 63, (100, 3), dtype=np.uint64)
    for n in (1, 2, 3, 4, 100):
        want = [sum(int(r[k // 64]) >> k % 64 & 1 for r in rows[:n]) for k in range(192)]
        assert network.walks.bits_by_lane(rows[:n]).tolist() == want


def test_closeness_of_every_node(spark):
    """No node is left out as a source."""
    from loomgraph.plans import graphs

    e = graphs.following(spark, "/root/testdata/sf0.001").where("source <> target")
    got = graphs.closeness(spark, "/root/testdata/sf0.001")
    assert got.count() == network.nodes(e).count() > 190
