"""Trees by doubling and tours against plain walks."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import trees

SCHEMA = "id long, node long, parent long, x double, y double, z double"
#: Parents of published examples with their orders.
DOC_TREE = [-1, 0, 1, 2, 1, 4, 5, 5], [2, 2, 1, 1, 2, 2, 1, 1]
WIDE_BRANCH = [-1, 0, 1, 1, 2, 2, 3, 3, 1, 1, 8, 8, 9, 9, 1], [3, 3, 2, 2, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1]


def skeleton(i, parents, at=None):
    at = at or [(1000.0 * k, 0.0, 0.0) for k in range(len(parents))]
    return [(i, k, p if p >= 0 else None, *map(float, xyz)) for k, (p, xyz) in enumerate(zip(parents, at))]


def grown(i, n, seed, roots=1, bushy=0.5):
    draw = random.Random(seed)
    names = draw.sample(range(10 * n), n)
    rows = []
    for k in range(n):
        if k < roots:
            parent = None
        else:
            parent = names[k - 1] if draw.random() > bushy else names[draw.randrange(k)]
        rows.append((i, names[k], parent, *(float(draw.randint(0, 50)) for _ in range(3))))
    draw.shuffle(rows)
    return rows


def walked(rows):
    """parent, kids, distance to the root, order, nodes below, by (id, node)."""
    at = {(r[0], r[1]): r for r in rows}
    up = {k: (k[0], r[2]) if r[2] is not None and (k[0], r[2]) in at and r[2] != k[1] else None for k, r in at.items()}
    kids = defaultdict(list)
    for k, p in up.items():
        if p:
            kids[p].append(k)
    order = []
    stack = [k for k, p in up.items() if not p]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += kids[k]
    step = {k: math.dist(at[k][3:6], at[p][3:6]) if p else 0.0 for k, p in up.items()}
    far, root = {}, {}
    for k in order:
        far[k] = step[k] + (far[up[k]] if up[k] else 0)
        root[k] = root[up[k]] if up[k] else k
    level, below = {}, {}
    for k in reversed(order):
        ks = [level[c] for c in kids[k]]
        level[k] = 1 if not ks else max(ks) + (ks.count(max(ks)) > 1)
        below[k] = {k}.union(*(below[c] for c in kids[k]))
    runs = {}
    for k in order:
        if up[k] and (up[up[k]] is None or len(kids[up[k]]) > 1):
            run, end = [k], k
            while len(kids[end]) == 1:
                end = kids[end][0]
                run.append(end)
            length, span = sum(step[c] for c in run), math.dist(at[up[k]][3:6], at[end][3:6])
            runs[k] = (run, length, length / span if span > 0 else None)
    return at, up, kids, step, far, level, below, runs, root


FOREST = [grown(1, 200, 1), grown(2, 60, 2, roots=4), grown(3, 1, 3), grown(4, 150, 4, bushy=0.05), grown(5, 120, 5, bushy=1.0)]
FOREST.append([(6, 0, 0, 0.0, 0.0, 0.0), (6, 1, 99, 1.0, 0.0, 0.0), (6, 2, 1, 1.0, 0.0, 0.0), (6, 3, 2, 1.0, 0.0, 0.0)])
ROWS = [r for rows in FOREST for r in rows]


@pytest.fixture(scope="module")
def forest(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tour(forest):
    return trees.toured(forest)


def test_tour_against_walks(tour):
    at, up, kids, step, far, _, below, runs, root = walked(ROWS)
    got = {(r.id, r.node): r for r in tour.collect()}
    assert got.keys() == at.keys() and sorted(r.place for r in got.values()) == list(range(len(ROWS)))
    inside = {k: {c for c, r in got.items() if got[k].place <= r.place < got[k].place + got[k].size} for k in got}
    for k, r in got.items():
        assert inside[k] == below[k] and r.kids == len(kids[k]) and r.parent == (up[k][1] if up[k] else None) and r.root == root[k][1]
        assert r.distance == pytest.approx(far[k]) and r.step == pytest.approx(step[k])
    for first, (run, _, _) in runs.items():
        assert {got[k].run for k in run} == {first[1]}


def test_orders_and_segments_against_walks(tour):
    _, _, _, _, _, level, _, runs, _ = walked(ROWS)
    orders = {(r.id, r.run): r.strahler for r in trees.strahler(tour).collect()}
    assert all(orders[(r.id, r.run)] == level[(r.id, r.node)] for r in tour.collect())
    got = {(r.id, r.run): (r.n_nodes, pytest.approx(r.length), r.tortuosity) for r in trees.segments(tour).collect()}
    assert got == {k: (len(run), length, pytest.approx(bend) if bend else None) for k, (run, length, bend) in runs.items()}


def test_published_orders(spark):
    rows = skeleton(1, DOC_TREE[0]) + skeleton(2, WIDE_BRANCH[0])
    tour = trees.toured(spark.createDataFrame(rows, SCHEMA))
    orders = tour.join(trees.strahler(tour), ["id", "run"]).orderBy("id", "node").collect()
    assert [r.strahler for r in orders] == DOC_TREE[1] + WIDE_BRANCH[1]
    assert {r.id: r.n for r in trees.segments(tour).where("id = 1").groupBy("id").agg({"run": "count"}).toDF("id", "n").collect()} == {1: 5}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    chain = spark.range(n).selectExpr("1L id", "id node", "nullif(id, 0) - 1 parent", "cast(id as double) x", "0d y", "0d z")
    whole = trees.measured
    monkeypatch.setattr(trees, "measured", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    tour = trees.toured(chain)
    assert len(rounds) <= 17 + 6
    assert tour.agg({"distance": "max", "depth": "max", "size": "max"}).first().asDict() == {"max(distance)": n - 1.0, "max(depth)": n - 1, "max(size)": n}
    assert [r.strahler for r in trees.strahler(tour).select("strahler").distinct().collect()] == [1]


def test_parents_in_a_circle_are_refused(spark):
    with pytest.raises(ValueError, match="circle"):
        trees.toured(spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 0.0), (1, 1, 2, 0.0, 0.0, 0.0), (1, 2, 0, 0.0, 0.0, 0.0)], SCHEMA))


def test_no_trees(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trees.topology(none).count() == 0 and trees.even_points(none, 1.0).count() == 0


def test_points_stand_for_all_cable(forest):
    at, up, kids, step, far, level, below, runs, _ = walked(ROWS)
    got = {(r.id, r.node): r.cable for r in trees.node_points(forest).collect()}
    assert got == {k: pytest.approx((step[k] + sum(step[c] for c in kids[k])) / 2) for k in at}
    points = defaultdict(dict)
    for r in trees.even_points(forest, 17.0).collect():
        assert r.piece not in points[(r.id, r.run)]
        points[(r.id, r.run)][r.piece] = r
    assert points.keys() == {k for k, (_, length, _) in runs.items() if length > 0}
    for k, made in points.items():
        run, length, _ = runs[k]
        n = max(1, math.ceil(length / 17.0 - 1e-9))
        assert sorted(made) == list(range(n)) and sum(r.cable for r in made.values()) == pytest.approx(length)
        for j, r in made.items():
            left = (j + 0.5) * length / n
            for c in run:
                if left <= step[c] or c == run[-1]:
                    break
                left -= step[c]
            t = min(1.0, left / step[c]) if step[c] else 0.0
            a, b = at[up[c]][3:6], at[c][3:6]
            assert (r.x, r.y, r.z) == pytest.approx(tuple(p + (q - p) * t for p, q in zip(a, b)), abs=1e-6)
            assert r.strahler == level[k]


def plain_split(rows, synapses, share=0.9, ratio=1.0):
    at, up, kids, *_, below, _, _ = walked(rows)
    near = defaultdict(set)
    for k, p in up.items():
        if p:
            near[k].add(p)
            near[p].add(k)
    out = {}
    for i in {k[0] for k in at}:
        own = [k for k in at if k[0] == i]
        n = {(k, p): sum(1 for s in synapses if (s[0], s[1]) == k and s[2] == p) for k in own for p in ("pre", "post")}
        pre, post = sum(n[k, "pre"] for k in own), sum(n[k, "post"] for k in own)
        status = "multiple roots" if sum(up[k] is None for k in own) > 1 else "no synapses" if not pre or not post else "ok"
        out.update({k: (None, None, status) for k in own})
        if status != "ok":
            continue
        raw = {}
        for k in own:
            a, b = sum(n[c, "pre"] for c in below[k]), sum(n[c, "post"] for c in below[k])
            raw[k] = a * (post - b) + b * (pre - a)
        flow = {k: max(raw[c] for c in kids[k]) if len(kids[k]) > 1 and up[k] else raw[k] for k in own}
        peak = max(flow.values())
        if peak <= 0:
            out.update({k: (None, flow[k], "no synapses") for k in own})
            continue
        label = {k: "linker" if flow[k] >= peak * share else None for k in own}
        parts, seen = [], set()
        for k in own:
            if label[k] or k in seen:
                continue
            part, stack = [], [k]
            seen.add(k)
            while stack:
                c = stack.pop()
                part.append(c)
                for d in near[c]:
                    if not label[d] and d not in seen:
                        seen.add(d)
                        stack.append(d)
            parts.append(part)
        counts = [[sum(n[c, p] for c in part) for p in ("pre", "post")] for part in parts]
        totals = [sum(c[q] for c in counts) for q in (0, 1)]
        for part, c in zip(parts, counts):
            f, g = (c[q] / totals[q] if totals[q] else 0.0 for q in (0, 1))
            if max(f, g) >= 0.01:
                for k in part:
                    label[k] = "axon" if g == 0 or f / g >= ratio else "dendrite"
        for name in ("axon", "dendrite"):
            keep = {k for k in own if label[k] in (name, "linker")}
            while True:
                loose = {k for k in keep if label[k] != name and len(near[k] & keep) <= 1}
                if not loose:
                    break
                keep -= loose
            for k in keep:
                label[k] = name
        while any(v is None for v in label.values()):
            # Nearest labelled node, the lesser on ties, all at once by distance.
            source = {}
            for k in own:
                if label[k] is None:
                    ring, passed = {k}, {k}
                    while ring and not any(label[c] for c in ring):
                        ring = {d for c in ring for d in near[c]} - passed
                        passed |= ring
                    hits = sorted(c for c in ring if label[c])
                    source[k] = label[hits[0]] if hits else None
            label.update(source)
            break
        out.update({k: (label[k], flow[k], "ok") for k in own})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_split_against_plain_walks(spark, forest, seed):
    draw = random.Random(seed)
    synapses = []
    for k, rows in enumerate(FOREST):
        for r in rows:
            # Outputs towards one end, inputs towards the other, some anywhere; none of one kind in one skeleton.
            for _ in range(draw.randint(0, 2)):
                synapses.append((r[0], r[1], "pre" if (r[3] + draw.randint(0, 30) > 40) and k != 4 else "post"))
    got = trees.split_compartments(forest, spark.createDataFrame(synapses, "id long, node long, polarity string"))
    wanted = plain_split(ROWS, synapses)
    assert {(r.id, r.node): (r.compartment, r.flow, r.status) for r in got.collect()} == wanted
    assert {v[2] for v in wanted.values()} == {"ok", "multiple roots", "no synapses"} and {v[0] for v in wanted.values()} >= {"axon", "dendrite", "linker"}
    table = {r.id: r for r in trees.segregation(got, spark.createDataFrame(synapses, "id long, node long, polarity string")).collect()}
    assert all(r.segregation is None or -1e-9 <= r.segregation <= 1 for r in table.values())


def test_segregation_of_known_mixtures(spark):
    split = spark.createDataFrame([(i, k, c, "ok") for i in (1, 2, 3) for k, c in enumerate(["axon", "dendrite"])], "id long, node long, compartment string, status string")
    rows = [(1, 0, "pre")] * 3 + [(1, 1, "post")] * 3 + [(2, k, p) for k in (0, 1) for p in ("pre", "post")] + [(3, 0, "pre")]
    got = trees.segregation(split, spark.createDataFrame(rows, "id long, node long, polarity string"))
    assert {r.id: r.segregation for r in got.collect()} == {1: pytest.approx(1.0), 2: pytest.approx(0.0), 3: 0.0}


def test_ways_are_followed_where_they_lie_before_anything_is_joined(spark, monkeypatch):
    rows = [(i, k, k - 1 if k else None) for i in range(3) for k in range(40)]
    links = spark.createDataFrame(rows, "id int, node int, up int")
    rounds, whole = [], trees.measured
    monkeypatch.setattr(trees, "measured", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    want = {(i, k): (0, float(k)) for i, k, _ in rows}
    for stretch, most in ((50_000, 3), (7, 7)):  # a skeleton is cut at the edge of a range of rows at most
        rounds.clear()
        monkeypatch.setattr(trees, "STRETCH", stretch)
        got = {(r.id, r.node): (r.top, r.sum) for r in trees.climbed(links, {"sum": F.lit(1.0)}).collect()}
        assert got == want and len(rounds) <= most
    table = spark.createDataFrame([(1, 1, 2, True, 1), (1, 2, 3, True, 1), (1, 3, 9, True, 1), (1, 5, 5, False, 0)], "id int, node int, top int, far boolean, n long")
    got = trees.followed(table.toArrow(), ["n"]).to_pylist()
    assert [(r["top"], r["far"], r["n"]) for r in got] == [(9, True, 3), (9, True, 2), (9, True, 1), (5, False, 0)]
