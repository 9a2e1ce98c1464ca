"""Linkage against merging one pair at a time, and meshes against solid shapes."""

import math
import random

import numpy as np
import pytest

from loomgraph.operators import linkage, meshes


def one_by_one(d, method):
    """Heights and cluster sizes of a tree, the nearest pair at a time, from points or a table of distances."""
    groups = {i: [i] for i in range(len(d))}
    out, sizes = dict(), []
    dist = {(i, j): d[i][j] for i in groups for j in groups if i < j}
    while len(groups) > 1:
        (i, j), h = min(dist.items(), key=lambda t: (t[1], t[0]))
        sizes.append((h, len(groups[i]) + len(groups[j]), tuple(sorted(groups[i] + groups[j]))))
        for k in groups:
            if k in (i, j):
                continue
            a, b = dist.pop((min(i, k), max(i, k))), dist.pop((min(j, k), max(j, k)))
            ni, nj, nk = len(groups[i]), len(groups[j]), len(groups[k])
            new = {"single": min(a, b), "complete": max(a, b), "average": (ni * a + nj * b) / (ni + nj), "ward": math.sqrt(max(0.0, ((ni + nk) * a * a + (nj + nk) * b * b - nk * h * h) / (ni + nj + nk)))}[method]
            dist[(min(i, k), max(i, k))] = new
        del dist[(i, j)]
        groups[i] = groups[i] + groups.pop(j)
    return sizes


def frame(spark, d):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i][j])) for i in range(n) for j in range(n) if i != j], "row long, col long, value double")


@pytest.mark.parametrize("method", linkage.METHODS)
def test_merges_are_those_of_one_pair_at_a_time(spark, method):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    merges = linkage.agglomerated(frame(spark, d), method)
    got = merges.orderBy("step").collect()
    wanted = one_by_one(d, method)
    assert [r.height for r in got] == pytest.approx([h for h, _, _ in wanted]) and [r["size"] for r in got] == [n for _, n, _ in wanted]
    members = spark.range(40)
    for k in (1, 4, 17, 40, 99):
        groups = {}
        for r in linkage.cut_by_count(merges, members, k).collect():
            groups.setdefault(r.cluster, set()).add(r.id)
        assert len(groups) == min(k, 40)
    sets = {tuple(sorted(s)) for s in cut(wanted, 40, wanted[30][0])}
    groups = {}
    for r in linkage.cut_by_height(merges, members, wanted[30][0] + 1e-9).collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {tuple(sorted(s)) for s in groups.values()} == sets


def cut(merges, n, height):
    found = {(i,) for i in range(n)}
    for h, _, whole in merges:
        if h <= height + 1e-9:
            found = {s for s in found if not set(s) <= set(whole)} | {whole}
    return found


def test_ties_give_exactly_as_many_clusters_as_asked(spark):
    d = np.full((6, 6), 5.0)
    for i in (0, 2, 4):
        d[i, i + 1] = d[i + 1, i] = 1.0
    merges = linkage.agglomerated(frame(spark, d), "average")
    for k in range(1, 7):
        assert linkage.cut_by_count(merges, spark.range(6), k).select("cluster").distinct().count() == k


def test_missing_pairs_are_refused(spark):
    with pytest.raises(ValueError, match="every pair"):
        linkage.agglomerated(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "row long, col long, value double"))
    assert linkage.agglomerated(spark.createDataFrame([], "row long, col long, value double")).count() == 0


def test_groups_that_draw_from_both_datasets(spark):
    """Two mixed pairs stay whole; a pair of one dataset is split, where a count would keep it."""
    rows = [(0, 0, 3, 0.1, 2), (1, 1, 4, 0.2, 2), (2, 2, 5, 0.3, 2), (3, 0, 1, 0.8, 4), (4, 0, 2, 0.9, 6)]
    merges = spark.createDataFrame(rows, "step long, left long, right long, height double, size long")
    members = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "A")], "id long, dataset string")
    got = {r.id: r.cluster for r in linkage.cut_mixed(merges, members, 0.8).collect()}
    assert got == {0: 0, 3: 0, 1: 1, 4: 1, 2: 2, 5: 5}


def plain_mixed(merges, dataset, share):
    names = set(dataset.values())
    kids = {}
    current = {i: ("leaf", i) for i in dataset}
    leaves = {("leaf", i): [i] for i in dataset}
    for s, a, b in merges:
        node = ("merge", s)
        kids[node] = (current[a], current[b])
        leaves[node] = leaves[current[a]] + leaves[current[b]]
        current[a] = node
    mixed = lambda v: {dataset[i] for i in leaves[v]} == names and max(sum(dataset[i] == n for i in leaves[v]) for n in names) <= share * len(leaves[v])
    out, stack = {}, [("merge", merges[-1][0])]
    while stack:
        v = stack.pop()
        if v not in kids or (mixed(v) and not any(map(mixed, kids[v]))):
            for i in leaves[v]:
                out[i] = min(leaves[v])
        else:
            stack += kids[v]
    return out


@pytest.mark.parametrize("share", [0.6, 0.8])
def test_mixed_cut_against_a_walk(spark, share):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dataset = {i: "AB"[int(rng.random() < 0.35)] for i in range(60)}
    merges = linkage.agglomerated(frame(spark, d), "average")
    wanted = plain_mixed([(r.step, r.left, r.right) for r in merges.orderBy("step").collect()], dataset, share)
    got = {r.id: r.cluster for r in linkage.cut_mixed(merges, spark.createDataFrame(list(dataset.items()), "id long, dataset string"), share).collect()}
    assert got == wanted and len(set(got.values())) < 60


# Meshes.


def cube(roi, lo, hi):
    """Twelve triangles of an axis-aligned box."""
    c = [(x, y, z) for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return [(roi, *map(float, c[q[0]] + c[q[i]] + c[q[i + 1]])) for q in quads for i in (1, 2)]


def torus(roi, big, small, n, m):
    at = lambda i, j: (
        (big + small * math.cos(2 * math.pi * j / m)) * math.cos(2 * math.pi * i / n), (big + small * math.cos(2 * math.pi * j / m)) * math.sin(2 * math.pi * i / n), small * math.sin(2 * math.pi * j / m),
    )
    out = []
    for i in range(n):
        for j in range(m):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            out += [(roi, *a, *b, *c), (roi, *a, *c, *d)]
    return out


TRIANGLES = "roi string, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def test_points_in_boxes_and_a_torus(spark):
    draw = random.Random(4)
    rows = cube("box", (0, 0, 0), (4, 4, 4)) + cube("small", (3, 3, 3), (5, 5, 5)) + torus("ring", 10.0, 2.0, 60, 40)
    points = [(k, draw.uniform(-13, 13), draw.uniform(-13, 13), draw.uniform(-3, 6), "old") for k in range(3_000)]
    # On the grid: rays through edges and corners of faces count once.
    points += [(5_000 + k, x + 0.5, float(y), float(z), "old") for k, (x, y, z) in enumerate((x, y, z) for x in range(-1, 6) for y in (1, 2, 3) for z in (1, 2, 3))]
    points.append((9_999, None, 1.0, 1.0, "old"))
    df = spark.createDataFrame(points, "point long, x double, y double, z double, roi string")
    got = {r.point: r.roi for r in meshes.in_meshes(df, spark.createDataFrame(rows, TRIANGLES), ["small", "box"]).collect()}
    assert len(got) == len(points)
    for k, x, y, z, _ in points:
        if x is None:
            assert got[k] is None
            continue
        deep = math.hypot(math.hypot(x, y) - 10.0, z)
        if abs(deep - 2.0) < 0.05:  # the ring of flat faces is a little thinner than the round one
            continue
        inner = lambda lo, hi: lo < x < hi and lo <= y < hi and lo <= z < hi
        wanted = {n for n, held in (("box", inner(0, 4)), ("small", inner(3, 5)), ("ring", deep < 2.0)) if held}
        assert got[k] in (wanted or {None}), (x, y, z)
        if wanted == {"box", "small"}:
            assert got[k] == "small"


def test_obj_files(spark, tmp_path):
    tri = "v 0 0 0\nv 1 0 0\n# a remark\nv 0 1 0\nv 0 0 1\nf 1 3 2\nf 1/1/1 2/2/2 4/4/4\nf -4 -1 -2\nf 2 3 4\n"
    quad = "o named\nv 0 0 0\nv 0 1 0\nv 0 1 1\nv 0 0 1\nvn 1 0 0\nf 1 2 3 4\nf 1 2 9\n"
    (tmp_path / "tri.obj").write_text(tri)
    (tmp_path / "quad.obj").write_text(quad)
    got = meshes.read_obj(spark, str(tmp_path))
    assert {r.roi: r["count"] for r in got.groupBy("roi").count().collect()} == {"tri": 4, "quad": 2}
    points = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 0.5, 0.5, 0.5)], "point long, x double, y double, z double")
    held = {r.point: r.roi for r in meshes.in_meshes(points, got.where("roi = 'tri'")).collect()}
    assert held == {0: "tri", 1: None}
    assert meshes.in_meshes(points, got.limit(0)).where("roi is not null").count() == 0
