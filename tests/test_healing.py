"""Bridges against Kruskal's forest on all pairs, parents against walks, and SWC files."""

import itertools
import math
import random
from collections import defaultdict

import pytest

from loomgraph.operators import healing, trees
from loomgraph.sources import skeletons

SCHEMA = "id long, node long, parent long, x double, y double, z double"


def fragments(i, seed, parts, n):
    """Random walks apart from each other, numbered at random."""
    draw = random.Random(seed)
    names, rows = draw.sample(range(100_000), parts * n), []
    for p in range(parts):
        at = [draw.uniform(0, 200) for _ in range(3)]
        for k in range(n if p else 2 * n):
            if len(rows) == len(names):
                break
            rows.append((i, names[len(rows)], rows[-1][1] if k else None, *at))
            at = [c + draw.uniform(-1, 1) for c in at]
    draw.shuffle(rows)
    return rows


def kruskal(rows, most=None):
    """Total length and number of the shortest bridges, by looking at all pairs."""
    at = {r[1]: r[3:6] for r in rows}
    root = {k: k for k in at}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for r in rows:
        if r[2] is not None:
            root[find(r[1])] = find(r[2])
    out = []
    for d, a, b in sorted((math.dist(at[a], at[b]), a, b) for a, b in itertools.combinations(sorted(at), 2)):
        if (most is None or d <= most) and find(a) != find(b):
            root[find(b)] = find(a)
            out.append((a, b, d))
    return out


ROWS = fragments(1, 1, 9, 25) + fragments(2, 2, 4, 40) + fragments(3, 3, 1, 30) + [(4, 0, None, 0.0, 0.0, 0.0), (4, 1, None, 5.0, 0.0, 0.0), (4, 2, None, 5.0, 0.0, 0.0)]


@pytest.mark.parametrize("most", [None, 60.0])
def test_bridges_are_those_of_a_least_forest(spark, most):
    got = defaultdict(set)
    for r in healing.bridges(spark.createDataFrame(ROWS, SCHEMA).repartition(3), most).collect():
        got[r.id].add((r.a, r.b, round(r.distance, 9)))
    for i in (1, 2, 3, 4):
        assert got[i] == {(a, b, round(d, 9)) for a, b, d in kruskal([r for r in ROWS if r[0] == i], most)}
    assert most is None or sum(map(len, got.values())) < 8 + 3 + 2


def test_healed_skeletons_are_trees_of_the_same_nodes(spark):
    nodes = spark.createDataFrame(ROWS, SCHEMA)
    out = healing.healed(nodes).collect()
    assert sorted((r.id, r.node, r.x, r.y, r.z) for r in out) == sorted((i, k, x, y, z) for i, k, _, x, y, z in ROWS)
    for i in (1, 2, 3, 4):
        mine, given = {r.node: r.parent for r in out if r.id == i}, [r for r in ROWS if r[0] == i]
        links = {frozenset((r[1], r[2])) for r in given if r[2] is not None} | {frozenset(b[:2]) for b in kruskal(given)}
        assert {frozenset((k, p)) for k, p in mine.items() if p is not None} == links and sum(p is None for p in mine.values()) == 1
        for k in mine:
            seen = 0
            while mine[k] is not None:
                k, seen = mine[k], seen + 1
                assert seen <= len(mine)
    sizes = defaultdict(int)
    roots = {r[1] for r in ROWS if r[0] == 2 and r[2] is None}
    up = {r[1]: r[2] for r in ROWS if r[0] == 2}
    for k in up:
        while up[k] is not None:
            k = up[k]
        sizes[k] += 1
    assert {r.node for r in out if r.id == 2 and r.parent is None} == {max(roots, key=lambda k: (sizes[k], -k))}


def test_far_fragments_stay_apart(spark):
    out = healing.healed(spark.createDataFrame(ROWS, SCHEMA), 4.0)
    assert out.where("id = 4 and parent is null").count() == 2


def test_swc_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.swc").write_text("# {\"a\": 1}\n1 1 0 0 0 2.5 -1\n 2\t3 1 0 0 0.5 1\n3 3 2 0 0\n4 3 nan 0 0 1 2\n5 2 2 0 0 1 2 extra\n6 2 2.5 1e1 0 1 2\n\n7 0 1 1 1 1 99\n")
    (tmp_path / "in" / "two.swc").write_text("10 0 0 0 0 0 -1\n11 0 3 4 0 0 10\n")
    got = skeletons.read_swc(spark, str(tmp_path / "in"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("one", 1, None, 0.0, 0.0, 0.0, 2.5, 1), ("one", 2, 1, 1.0, 0.0, 0.0, 0.5, 3), ("one", 6, 2, 2.5, 10.0, 0.0, 1.0, 2), ("one", 7, 99, 1.0, 1.0, 1.0, 1.0, 0), ("two", 10, None, 0.0, 0.0, 0.0, 0.0, 0), ("two", 11, 10, 3.0, 4.0, 0.0, 0.0, 0)]
    table = {r.id: r for r in trees.topology(got).collect()}
    assert table["one"].roots == 2 and table["two"].cable == 5.0
    skeletons.write_swc(got.where("id = 'two'"), str(tmp_path / "out"))
    back = skeletons.read_swc(spark, str(tmp_path / "out" / "id=two"))
    assert sorted(map(tuple, back.drop("id").collect())) == [r[1:] for r in rows if r[0] == "two"]


def test_rows_repeated_for_the_cells_around_are_not_broadcast(spark):
    rows = [(i, k, k % 3, float(k), float(i), 0.0) for i in range(4) for k in range(30)]
    spots = spark.createDataFrame(rows, "id long, node long, part long, x double, y double, z double")
    frames, write = [], healing.checkpointed
    try:
        healing.checkpointed = lambda df: (frames.append(df), write(df))[1]
        found = healing.shortest_bridges(spots, 2.0)
    finally:
        healing.checkpointed = write
    for df in [*frames, found]:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 12
