"""The edge store, searches over it, and the options of paths and influence."""

import random
import re
from collections import defaultdict

import pytest

from loomgraph.functions import lineage
from loomgraph.operators import network
from loomgraph.sources.edges import EdgeStore


def moved_scans(plan):
    """Scans of bucketed tables that an exchange moves before they reach a join or a sum."""
    above, moved, seen = [], [], 0
    for line in plan.splitlines():
        depth = len(re.match(r"[ :+\-*]*", line)[0])
        above = [(d, n) for d, n in above if d < depth]
        if "Bucketed: true" in line:
            seen += 1
            for _, name in reversed(above):
                if "Join" in name or "Aggregate" in name:
                    break
                if "Exchange" in name:
                    moved.append(line)
        above.append((depth, line))
    return seen, moved


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def links(seed, n, m):
    draw = random.Random(seed)
    found = defaultdict(int)
    for _ in range(m):
        found[draw.randrange(n), draw.randrange(n)] += draw.randint(1, 5)
    return dict(found)


def frame(spark, found):
    return spark.createDataFrame([(a, b, w) for (a, b), w in found.items()], "source long, target long, weight long")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_store_reads_either_end_without_moving_edges(spark, tmp_path, no_broadcast):
    found = links(1, 40, 300)
    EdgeStore.save(frame(spark, found).repartition(3), f"{tmp_path}/store", 4)
    store, asked = EdgeStore.open(spark, f"{tmp_path}/store"), ids(spark, 1, 2, 3)
    for direction, end in (("outputs", 0), ("inputs", 1)):
        df = store.edges_of(asked, direction)
        assert {(a, b): w for a, b, w in df.collect()} == {k: w for k, w in found.items() if k[end] in (1, 2, 3)}
        seen, moved = moved_scans(plan(df))
        assert seen and not moved
    assert {(r.source, r.target): r.weight for r in store.between(asked, ids(spark, 5, 6)).collect()} == {k: w for k, w in found.items() if k[0] in (1, 2, 3) and k[1] in (5, 6)}
    totals = store.totals()
    assert moved_scans(plan(totals)) == (2, []) and "Exchange" not in plan(totals)
    assert {r.id: (r.n_out, r.in_weight) for r in totals.collect()} == {i: (sum(k[0] == i for k in found), sum(w for k, w in found.items() if k[1] == i)) for i in {x for k in found for x in k}}


def test_a_step_among_labels_sums_pairs(spark, tmp_path):
    store = EdgeStore.save(frame(spark, {(1, 10): 3, (2, 10): 4, (2, 11): 5, (3, 12): 1}), f"{tmp_path}/store")
    labels = spark.createDataFrame([(1, "A"), (2, "A"), (10, "P"), (11, "P")], "id long, label string")
    got = {tuple(r) for r in store.step(ids(spark, 1, 2, 3), labels=labels).collect()}
    assert got == {("A", "P", 12, 3), ("3", "12", 1, 1)}


def test_stored_and_given_edges_answer_alike(spark, tmp_path):
    found = links(2, 60, 200)
    given, seeds = frame(spark, found), ids(spark, 3, 4)
    store = EdgeStore.save(given, f"{tmp_path}/store")
    for direction in ("downstream", "upstream", "any"):
        assert sorted(map(tuple, network.reach(store, seeds, 3, direction).collect())) == sorted(map(tuple, network.reach(given, seeds, 3, direction).collect()))
    for direction in ("outputs", "inputs", "both"):
        both = [sorted(map(tuple, network.connectivity(e, seeds, 2, direction, 2, "postsynaptic").collect())) for e in (store, given)]
        assert both[0] == both[1] and both[0]
    both = [network.paths(e, seeds, ids(spark, 7, 8, 9), 4, 10).collect() for e in (store, given)]
    assert both[0] == both[1] and both[0]


def test_no_round_moves_edges(spark, monkeypatch, no_broadcast):
    """Of every state that a round writes, the plan reads edges from their buckets."""
    plans, given = [], frame(spark, links(3, 60, 400))
    written = lineage.checkpointed
    for module in (lineage, network):
        monkeypatch.setattr(module, "checkpointed", lambda df: plans.append(plan(df)) or written(df))
    for run in (
        lambda: network.pagerank(given, rounds=3, tolerance=0),
        lambda: network.reach(given, ids(spark, 1), 3, "any"),
        lambda: network.connectivity(given, ids(spark, 1), 2, "both"),
        lambda: network.paths(given, ids(spark, 1), ids(spark, 2), 3, 5),
        lambda: network.influence(given, ids(spark, 1), 3),
        lambda: network.eigenvector(given, rounds=2, tolerance=0),
    ):
        plans.clear()
        run()
        read = [moved_scans(p) for p in plans]
        assert sum(n for n, _ in read) >= 2 and not [m for _, ms in read for m in ms]


def test_states_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda _: f"file://{tmp_path}")
    network.pagerank(frame(spark, links(4, 30, 90)), rounds=6, tolerance=0).collect()
    assert len(list(tmp_path.glob("*/*"))) <= 4


# Paths by type and by fraction.

POPULATIONS = {("A", "W"): 900, ("W", "D"): 900, ("A", "Y"): 60, ("Y", "D"): 60}
TOTALS = {"W": 90_000, "Y": 100, "D": 1_000}


def populations(spark, totals):
    """What each population receives in all, the rest of it from nowhere that matters."""
    rows = [(a, b, w) for (a, b), w in POPULATIONS.items()]
    rows += [(f"rest of {b}", b, n - sum(w for k, w in POPULATIONS.items() if k[1] == b)) for b, n in totals.items()]
    return spark.createDataFrame(rows, "source string, target string, weight long")


def names(spark, *given):
    return spark.createDataFrame([(n,) for n in given], "id string")


def test_paths_by_synapses_and_by_fraction_disagree(spark):
    e = populations(spark, TOTALS)
    by_weight = network.paths(e, names(spark, "A"), names(spark, "D"), 2, 5, normalize_by="postsynaptic").collect()
    by_share = network.paths(e, names(spark, "A"), names(spark, "D"), 2, 5, normalize_by="postsynaptic", rank_by="fraction").collect()
    assert [r.path for r in by_weight] == [["A", "W", "D"], ["A", "Y", "D"]] and [r.path for r in by_share] == [["A", "Y", "D"], ["A", "W", "D"]]
    assert by_share[0].bottleneck == 60 and by_share[0].bottleneck_norm == pytest.approx(0.06) and by_share[1].bottleneck_norm == pytest.approx(0.01)
    assert [r.path for r in network.paths(e, names(spark, "A"), names(spark, "D"), 2, 1, normalize_by="postsynaptic", rank_by="fraction").collect()] == [["A", "Y", "D"]]
    floor = network.paths(e, names(spark, "A"), names(spark, "D"), 2, 5, normalize_by="postsynaptic", min_fraction=0.05).collect()
    assert [r.path for r in floor] == [["A", "Y", "D"]]


def test_what_cannot_be_measured_is_kept_and_ranks_last(spark):
    e = spark.createDataFrame([("A", "W", 0), ("W", "D", 50), ("A", "Y", 6), ("Y", "D", 6)], "source string, target string, weight long")
    got = network.paths(e, names(spark, "A"), names(spark, "D"), 2, 5, normalize_by="postsynaptic", rank_by="fraction", min_fraction=0.05).collect()
    assert [(r.path, r.bottleneck_norm is None) for r in got] == [(["A", "Y", "D"], False), (["A", "W", "D"], True)]


def test_paths_of_types_need_no_path_of_neurons(spark):
    e = frame(spark, {(1, 10): 5, (11, 20): 7, (2, 10): 1})
    labels = spark.createDataFrame([(1, "LC"), (2, "LC"), (10, "P"), (11, "P"), (20, "DN")], "id long, label string")
    assert network.paths(e, ids(spark, 1), ids(spark, 20), 3, 5).count() == 0
    assert [tuple(r) for r in network.paths(e, ids(spark, 1), ids(spark, 20), 3, 5, labels=labels).collect()] == [(["LC", "P", "DN"], 2, 6.0, 1)]


# Influence: seeds apart, logarithm, what a kept frontier loses.


def test_seeds_apart_add_up(spark):
    given, seeds = frame(spark, links(5, 30, 120)), ids(spark, 1, 2, 3)
    whole = {r.id: r for r in network.influence(given, seeds, 3, 0.5).collect()}
    apart = defaultdict(float)
    for r in network.influence(given, seeds, 3, 0.5, by_seed=True).collect():
        apart[r.id] += r.influence
    assert apart == {i: pytest.approx(r.influence) for i, r in whole.items()}
    assert {i for i, r in whole.items() if r.seed} == {1, 2, 3} and all((r.hops == 0) == r.seed for r in whole.values())
    shared = {r.id: r.influence for r in network.influence(given, seeds, 3, 0.5, share_mass=True).collect()}
    assert shared == {i: pytest.approx(r.influence / 3) for i, r in whole.items()}


def test_logarithm_of_influence(spark):
    e = frame(spark, {(1, 2): 1, (9, 2): 10**12})
    got = {r.id: r.influence_log for r in network.influence(e, ids(spark, 1), 1).collect()}
    assert got[1] == pytest.approx(24.0) and got[2] == 0.0


def test_a_kept_frontier_says_what_it_loses(spark):
    e = frame(spark, {(1, 2): 3, (9, 2): 1, (1, 3): 1, (9, 3): 3, (2, 4): 1, (3, 4): 1})
    whole, none = network.spread(e, ids(spark, 1), 2)
    part, lost = network.spread(e, ids(spark, 1), 2, keep=1)
    assert [x["held_back"] for x in none] == [0.0, 0.0] and [x["held_back"] for x in lost] == [0.0, pytest.approx(0.25)]
    assert {r.id: r.influence for r in whole.collect()} == {1: 1.0, 2: 0.75, 3: 0.25, 4: pytest.approx(0.5)}
    assert {r.id: r.influence for r in part.collect()} == {1: 1.0, 2: 0.75, 3: 0.25, 4: pytest.approx(0.375)}
    assert network.unwalked(0.5, 0.5) == 0.5 and network.unwalked(0.5, 1.0) is None
