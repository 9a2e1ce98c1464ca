"""Forests of skeleton nodes (id, node, parent, x, y, z, ...): measures that depend on the way to the root or on all that lies below.

Nothing walks a tree. Unbranched runs are found by pointer doubling, in as many rounds as the logarithm of the longest run; the tree of
runs, far smaller, is numbered by ranking its Euler tour, which is pointer doubling again. With that numbering a subtree is an interval, and
sums over subtrees are differences of running sums over ranges. So a chain of 100,000 nodes costs 17 rounds, and no skeleton is one task.

A parent that no row of the skeleton has, or that is the node itself, makes a root. A skeleton may have several roots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed, forget, measured, running

AXES = ("x", "y", "z")


def apart(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in AXES]))


def climbed(links: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """(id, node, top, weights) of links (id, node, up): where the way up ends, and the sums of weights along it. up is null at the end.

    Links come in ranges of (id, node), and a stretch of them first goes as far up as it holds the way. What is left takes rounds, each of which doubles the part of
    the way that a row knows: it joins what is known of the place it has come to.
    """
    ends = F.col("up").isNull()
    start = links.select("id", "node", F.coalesce("up", "node").alias("top"), (~ends).alias("far"), *[F.when(ends, F.lit(0)).otherwise(c).alias(n) for n, c in weights.items()])
    start = start.repartitionByRange("id", "node").sortWithinPartitions("id", "node")
    state, seen = measured(start.mapInArrow(gone_up(list(weights)), start.schema), rows=F.count("*"), far=F.count_if("far"))
    rounds = 0
    while seen["far"]:
        if 1 << rounds > seen["rows"]:
            raise ValueError("parents lead round in a circle")
        known = state.select("id", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("far").alias("_far"), *[F.col(n).alias(f"_{n}") for n in weights])
        moved = state.where("far").join(known, ["id", "top"]).select("id", "node", F.col("_top").alias("top"), F.col("_far").alias("far"), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in weights])
        after, seen = measured(state.where("not far").union(moved), rows=F.count("*"), far=F.count_if("far"))
        forget(state)
        state, rounds = after, rounds + 1
    return state.drop("far")


#: Rows of a stretch in which ways are followed before anything is joined.
STRETCH = 50_000


def codes(columns: list[list[pa.Array]]) -> np.ndarray:
    """A number for each row of columns, each given in parts, equal for equal rows. Structs count by their fields."""
    out = None
    while columns:
        parts, *columns = columns
        if pa.types.is_struct(parts[0].type):
            columns = [[p.field(i) for p in parts] for i in range(parts[0].type.num_fields)] + columns
            continue
        one = pa.chunked_array(parts).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = one if out is None else np.unique(out * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
    return out


def followed(table: pa.Table, weights: list[str]) -> pa.Table:
    """Rows (id, node, top, far, weights) after all steps that rows of the same table know, by doubling; ways in a circle stay as they are."""
    n = table.num_rows
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    key = codes([[column["id"], column["id"]], [column["node"], column["top"]]])
    at = np.full(int(key.max()) + 1, -1, np.int64)
    at[key[:n]] = np.arange(n)
    far, to, sums = column["far"].to_numpy(zero_copy_only=False).copy(), np.arange(n), {w: column[w].to_numpy(zero_copy_only=False).copy() for w in weights}
    where = np.where(far, at[key[n:]], -1)
    for _ in range(n.bit_length() + 1):
        i = np.flatnonzero(where >= 0)
        if not len(i):
            break
        j = where[i]
        for w in weights:
            sums[w][i] += sums[w][j]
        to[i], far[i], where[i] = to[j], far[j], where[j]
    else:
        return table
    made = {"top": column["top"].take(pa.array(to)), "far": pa.array(far), **{w: pa.array(v, column[w].type) for w, v in sums.items()}}
    return pa.table([made.get(c, column[c]) for c in table.column_names], schema=table.schema)


def gone_up(weights: list[str]):
    """followed for stretches of sorted rows, which end with a skeleton where they can."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= STRETCH:
                whole = pa.Table.from_batches(held)
                ids = codes([whole.column("id").chunks])
                ends = np.flatnonzero(ids[1:] != ids[:-1])
                cut = int(ends[-1]) + 1 if len(ends) else rows
                yield from followed(whole.slice(0, cut), weights).to_batches()
                held, rows = whole.slice(cut).to_batches(), rows - cut
        if rows:
            yield from followed(pa.Table.from_batches(held), weights).to_batches()

    return go


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes with parent (null at roots), kids, step (the distance to the parent, 0 at roots), first (whether an unbranched run begins here).

    A run begins at a root, below a root and below a branch point.
    """
    # Self-joins on (id, parent): the nodes' table is read as its own parents and as the sizes of its broods.
    above = nodes.select("id", F.col("node").alias("parent"), *[F.col(c).alias(f"_{c}") for c in AXES])
    own = nodes.withColumn("parent", F.when(F.col("parent") != F.col("node"), F.col("parent")))
    held = own.join(above, ["id", "parent"], "left").withColumn("parent", F.when(F.col("_x").isNotNull(), F.col("parent")))
    held = held.withColumn("step", F.coalesce(apart("", "_"), F.lit(0.0))).drop(*[f"_{c}" for c in AXES])
    held = checkpointed(held)
    broods = held.where("parent is not null").groupBy("id", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    held = held.join(broods, ["id", "node"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    above = held.select("id", F.col("node").alias("parent"), ((F.col("kids") != 1) | F.col("parent").isNull()).alias("_begins"))
    return checkpointed(held.join(above, ["id", "parent"], "left").withColumn("first", F.coalesce("_begins", F.lit(True))).drop("_begins"))


def toured(nodes: DataFrame) -> DataFrame:
    """rooted(nodes) with root, run (the run's first node), depth and distance from the root, place and size, checkpointed.

    place numbers all nodes, each before those below it, and a subtree is the size nodes from its place on. run_place and runs_below do the same for
    runs. A run's nodes follow each other.
    """
    held = rooted(nodes)
    inside = climbed(held.select("id", "node", F.when(~F.col("first"), F.col("parent")).alias("up"), "step"), {"hops": F.lit(1).cast("long"), "along": F.col("step")})
    inside = checkpointed(held.select("id", "node", "parent", "step").join(inside, ["id", "node"]))
    # A run hangs on the node above its first; what it takes to reach that node's own run's first is the weight of the link.
    firsts = inside.where("node = top").select("id", F.col("node").alias("run"), "parent", "step")
    above = inside.select("id", F.col("node").alias("parent"), F.col("top").alias("on"), F.col("hops").alias("_hops"), F.col("along").alias("_along"))
    sizes = inside.groupBy("id", F.col("top").alias("run")).agg(F.count("*").alias("length"))
    runs = checkpointed(firsts.join(above, ["id", "parent"], "left").join(sizes, ["id", "run"]).select("id", "run", "on", "step", "_hops", "_along", "length"))
    depths = climbed(runs.select("id", F.col("run").alias("node"), F.col("on").alias("up"), "step", "_hops", "_along"), {"depth": 1 + F.col("_hops"), "distance": F.col("step") + F.col("_along")})
    # The Euler tour: down into a run, through the runs on it in order, and up again.
    brood = W.partitionBy("id", "on").orderBy("run")
    order = runs.select("id", "run", "on", F.when(F.col("on").isNotNull(), F.lead("run").over(brood)).alias("next"))
    eldest = runs.where("on is not null").groupBy("id", F.col("on").alias("run")).agg(F.min("run").alias("child"))
    arc = lambda run, side: F.struct(F.col(run).alias("run"), F.lit(side).alias("side"))
    order = checkpointed(order.join(eldest, ["id", "run"], "left"))
    down = order.select("id", arc("run", 0).alias("node"), F.when(F.col("child").isNull(), arc("run", 1)).otherwise(arc("child", 0)).alias("up"))
    up = order.select("id", arc("run", 1).alias("node"), F.when(F.col("next").isNotNull(), arc("next", 0)).when(F.col("on").isNotNull(), arc("on", 1)).alias("up"))
    ranks = climbed(down.union(up), {"rank": F.lit(1).cast("long")}).select("id", "node.run", "node.side", F.col("top.run").alias("root"), "rank")
    both = ranks.groupBy("id", "run").agg(F.first("root").alias("root"), F.max("rank").alias("enter"), F.min("rank").alias("leave"))
    both = both.select("id", "run", "root", "enter", ((F.col("enter") - F.col("leave") + 1) / 2).cast("long").alias("runs_below"))
    numbered = running(both.join(runs.select("id", "run", "length"), ["id", "run"]), [F.col("id"), F.col("root"), F.col("enter").desc()], {"upto": F.col("length")}, name="run_place")
    numbered = checkpointed(numbered)
    ends = numbered.select((F.col("run_place") - F.col("runs_below") + 1).alias("_from"), "run_place", "upto")
    lasts = numbered.select((F.col("run_place") + F.col("runs_below") - 1).alias("_last"), "id", "run", "root", "run_place", "runs_below", (F.col("upto") - F.col("length")).alias("start"))
    placed = lasts.join(ends.select(F.col("run_place").alias("_last"), F.col("upto").alias("end")), "_last").drop("_last")
    placed = placed.join(depths.select("id", F.col("node").alias("run"), "depth", "distance"), ["id", "run"])
    out = inside.select("id", "node", F.col("top").alias("run"), "hops", "along").join(placed, ["id", "run"])
    out = out.select("id", "node", "run", "root", "run_place", "runs_below", (F.col("depth") + F.col("hops")).alias("depth"), (F.col("distance") + F.col("along")).alias("distance"), (F.col("start") + F.col("hops")).alias("place"), (F.col("end") - F.col("start") - F.col("hops")).alias("size"))
    return checkpointed(held.join(out, ["id", "node"]))


def below(df: DataFrame, keys: list[str], place: str, size: str, sums: dict[str, Column]) -> DataFrame:
    """keys and sums over the rows of df whose place lies in the size places from a row's own on; keys tell rows apart and begin with the group within which rows count.

    A row is there twice, where its stretch begins and where it ends; what has run up between the two is its sum.
    """
    group = keys[:1]
    begin = df.select(*keys, F.col(place).alias("_spot"), F.lit(1).alias("_kind"), *[c.cast("long").alias(n) for n, c in sums.items()])
    end = df.select(*keys, (F.col(place) + F.col(size)).alias("_spot"), F.lit(0).alias("_kind"), *[F.lit(0).cast("long").alias(n) for n in sums])
    upto = running(begin.union(end), [*map(F.col, group), F.col("_spot"), F.col("_kind")], {f"_{n}": F.col(n) for n in sums}, name="_row")
    part = lambda n: F.sum(F.when(F.col("_kind") == 0, F.col(f"_{n}")).otherwise(F.col(n) - F.col(f"_{n}"))).alias(n)
    return upto.groupBy(*keys).agg(*[part(n) for n in sums])


def strahler(tour: DataFrame) -> DataFrame:
    """(id, run, strahler) for a tour: 1 at runs that nothing hangs on; the greatest order of what hangs on a run, and one more where at least two have it.

    An order is reached above every run on which two of the order before hang, so each order is one count of such runs below, and
    there are at most as many as the logarithm of the number of tips.
    """
    firsts = tour.where("first")
    runs = checkpointed(firsts.select("id", "run", "run_place", "runs_below", F.col("parent")))
    above = tour.join(runs.select("id", F.col("parent").alias("node")).distinct(), ["id", "node"], "left_semi").select("id", F.col("node").alias("parent"), F.col("run").alias("on"))
    links = checkpointed(runs.join(above, ["id", "parent"]).select("id", "run", "on"))
    state, level = checkpointed(runs.select("id", "run", "run_place", "runs_below", F.lit(1).alias("strahler"))), 1
    while True:
        high = state.where(F.col("strahler") == level).select("id", "run")
        forks = links.join(high, ["id", "run"], "left_semi").groupBy("id", F.col("on").alias("run")).agg(F.count("*").alias("n")).where("n > 1").select("id", "run", F.lit(1).alias("fork"))
        forks = checkpointed(forks)
        if forks.isEmpty():
            return state.select("id", "run", "strahler")
        marked = state.join(forks, ["id", "run"], "left")
        reached = below(marked, ["id", "run"], "run_place", "runs_below", {"forks": F.coalesce("fork", F.lit(0))}).where("forks > 0").select("id", "run", F.lit(True).alias("_up"))
        after = checkpointed(state.join(reached, ["id", "run"], "left").select("id", "run", "run_place", "runs_below", F.when(F.col("_up"), level + 1).otherwise(F.col("strahler")).alias("strahler")))
        forget(state, forks)
        state, level = after, level + 1


def segments(tour: DataFrame) -> DataFrame:
    """(id, run, n_nodes, length, tortuosity): unbranched runs below roots and branch points, the link to what they hang on included.

    tortuosity is length over the straight way between the two ends, null where they are one place.
    """
    ends = F.struct("place", *AXES)
    own = tour.where("distance > 0 or parent is not null").groupBy("id", "run").agg(F.count("*").alias("n_nodes"), F.sum("step").alias("length"), F.max(ends).alias("_end"), F.max(F.when(F.col("first"), F.col("parent"))).alias("node"))
    above = tour.select("id", "node", *[F.col(c).alias(f"a{c}") for c in AXES])
    met = own.join(above, ["id", "node"]).select("*", *[F.col(f"_end.{c}").alias(f"b{c}") for c in AXES])
    span = apart("a", "b")
    return met.select("id", "run", "n_nodes", "length", F.when(span > 0, F.col("length") / span).alias("tortuosity"))


def topology(nodes: DataFrame) -> DataFrame:
    """One row a skeleton: n_nodes, roots, branch_points, end_points, cable, segments, mean_tortuosity, max_strahler, max_distance (from the root)."""
    tour = toured(nodes)
    orders = strahler(tour).groupBy("id").agg(F.max("strahler").alias("max_strahler"))
    parts = segments(tour).groupBy("id").agg(F.count("*").alias("segments"), F.avg("tortuosity").alias("mean_tortuosity"))
    own = tour.groupBy("id").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.expr("kids > 1 and parent is not null")).alias("branch_points"),
        F.count_if(F.expr("kids = 0 and parent is not null")).alias("end_points"), F.sum("step").alias("cable"), F.max("distance").alias("max_distance"),
    )
    out = own.join(parts, "id", "left").join(orders, "id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return out.select("id", "n_nodes", "roots", "branch_points", "end_points", "cable", "segments", "mean_tortuosity", "max_strahler", "max_distance")


def node_points(nodes: DataFrame) -> DataFrame:
    """(id, node, x, y, z, cable, strahler, distance): a point a node, which stands for half of each of its links."""
    tour = toured(nodes)
    halves = tour.where("parent is not null").groupBy("id", F.col("parent").alias("node")).agg(F.sum("step").alias("_below"))
    met = tour.join(halves, ["id", "node"], "left").join(strahler(tour), ["id", "run"])
    return met.select("id", "node", *AXES, ((F.col("step") + F.coalesce("_below", F.lit(0.0))) / 2).alias("cable"), "strahler", "distance")


def even_points(nodes: DataFrame, spacing: float) -> DataFrame:
    """(id, run, piece, x, y, z, cable, strahler, distance): each run cut into equal pieces of at most spacing, a point in the middle of each.

    The cable of a run's points sums to its length; a run without length has none. Each link makes the points whose middle lies on it: one row a link, one a point, and
    no row for what a run is made of.
    """
    tour = toured(nodes)
    above = tour.select("id", F.col("node").alias("parent"), *[F.col(c).alias(f"a{c}") for c in AXES], F.col("distance").alias("_from"))
    links = tour.where("parent is not null").join(above, ["id", "parent"])
    spans = links.groupBy("id", "run").agg(F.sum("step").alias("length"), F.min("_from").alias("_base"))
    links = links.join(spans.where("length > 0"), ["id", "run"]).join(strahler(tour), ["id", "run"])
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / spacing - 1e-9)).cast("long")
    links = links.withColumns({"pieces": pieces, "piece_length": F.col("length") / pieces})
    # Piece j has its middle at (j + 1/2) lengths. The last node's link takes what rounding leaves beyond it.
    upto = lambda at: F.ceil(at / F.col("piece_length") - 0.5).cast("long")
    low = F.when(F.col("first"), F.lit(0)).otherwise(F.least(upto(F.col("_from") - F.col("_base")), F.col("pieces")))
    high = F.when(F.col("kids") != 1, F.col("pieces")).otherwise(F.least(upto(F.col("distance") - F.col("_base")), F.col("pieces")))
    made = links.withColumns({"_low": low, "_high": high}).where("_high > _low").withColumn("piece", F.explode(F.sequence("_low", F.col("_high") - 1)))
    t = F.when(F.col("step") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("piece") + 0.5) * F.col("piece_length") - (F.col("_from") - F.col("_base"))) / F.col("step")))).otherwise(0.0)
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_t")
    made = made.withColumn("_t", t)
    return made.select("id", "run", "piece", *[at(f"a{c}", c).alias(c) for c in AXES], F.col("piece_length").alias("cable"), "strahler", at("_from", "distance").alias("distance"))


def unassigned_nearest(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, node, compartment) of labels with its nulls filled from the nearest labelled node along links (id, node, near; both ways); ties go to the lesser such node."""
    known, open_ = labels.where("compartment is not null"), checkpointed(labels.where("compartment is null").select("id", "node"))
    front = known.select("id", "node", F.struct(F.col("node").alias("source"), "compartment").alias("best"))
    found = []
    while not open_.isEmpty():
        told = open_.join(links, ["id", "node"]).join(front.select("id", F.col("node").alias("near"), "best"), ["id", "near"])
        front = checkpointed(told.groupBy("id", "node").agg(F.min("best").alias("best")))
        if front.isEmpty():
            break
        found.append(front.select("id", "node", "best.compartment"))
        after = checkpointed(open_.join(front, ["id", "node"], "left_anti"))
        forget(open_)
        open_ = after
    rest = open_.withColumn("compartment", F.lit(None).cast("string"))
    return reduce(lambda a, b: a.union(b), [*found, rest], known.select("id", "node", "compartment"))


def reunited(tour: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """labels in which linker nodes that lie between nodes of a label, over linker and that label alone, have the label too.

    Such a node has nodes of the label in at least two directions: below some of its children, or elsewhere in its part of the tree. Parts keep the order of the whole
    tour, so what lies below a node within its part is a stretch of the part's places.
    """
    allowed = checkpointed(labels.where(F.col("compartment").isin(label, "linker")).join(tour.select("id", "node", "parent", "place", "size"), ["id", "node"]))
    inner = allowed.select("id", F.col("node").alias("parent"), F.lit(True).alias("_in"))
    links = allowed.join(inner, ["id", "parent"], "left").select("id", "node", F.when(F.col("_in"), F.col("parent")).alias("up"))
    parts = climbed(links, {}).select("id", "node", F.struct("id", "top").alias("part"))
    held = checkpointed(allowed.join(parts, ["id", "node"]).join(links, ["id", "node"]).withColumn("seed", (F.col("compartment") == label).cast("long")))
    counts = below(held, ["part", "id", "node"], "place", "size", {"seeds": F.col("seed")})
    counts = checkpointed(held.select("part", "id", "node", "up", "seed").join(counts.drop("part"), ["id", "node"]))
    whole = counts.groupBy("part").agg(F.sum("seed").alias("all_seeds"))
    sides = counts.where("up is not null and seeds > 0").groupBy("id", F.col("up").alias("node")).agg(F.count("*").alias("sides"))
    between = counts.join(whole, "part").join(sides, ["id", "node"], "left")
    between = between.where((F.col("seed") == 0) & (F.coalesce("sides", F.lit(0)) + (F.col("all_seeds") > F.col("seeds")).cast("int") > 1)).select("id", "node", F.lit(True).alias("_now"))
    return checkpointed(labels.join(between, ["id", "node"], "left").select("id", "node", F.when(F.col("_now"), F.lit(label)).otherwise(F.col("compartment")).alias("compartment")))


#: Parts that hold less than this share of both kinds of synapses are told by what is next to them.
LEAST_SHARE = 0.01


def split_compartments(nodes: DataFrame, synapses: DataFrame, flow_share: float = 0.9, ratio: float = 1.0) -> DataFrame:
    """(id, node, compartment, flow, status): axon, dendrite or linker by synapse flow, after Schneider-Mizell et al. (2016).

    synapses: (id, node, polarity), pre or post. flow counts the ways from inputs to outputs that pass a node's link, both ways round; a branch point has the greatest of its
    children's. Nodes of at least flow_share of the peak are linker. What is left falls into parts; a part whose share of the outputs is at least ratio times its share
    of the inputs is axon, others dendrite; parts below LEAST_SHARE of both take the label of the nearest node. Linker between two axon nodes (then: dendrite nodes) is axon (dendrite).
    status is ok, multiple roots or no synapses (of one kind); there is no compartment but where it is ok.
    """
    polar = lambda p: F.count_if(F.col("polarity") == p)
    tour = toured(nodes)
    counts = synapses.groupBy("id", "node").agg(polar("pre").alias("pre"), polar("post").alias("post"))
    held = tour.select("id", "node", "parent", "kids", "place", "size").join(counts, ["id", "node"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pre", "post")})
    held = checkpointed(held)
    every = held.groupBy("id").agg(F.count_if(F.col("parent").isNull()).alias("roots"), F.sum("pre").alias("all_pre"), F.sum("post").alias("all_post"))
    every = every.withColumn("status", F.when(F.col("roots") > 1, "multiple roots").when((F.col("all_pre") == 0) | (F.col("all_post") == 0), "no synapses").otherwise("ok"))
    every = checkpointed(every)
    may = held.join(every.where("status = 'ok'"), "id")
    sums = below(may, ["id", "node"], "place", "size", {"far_pre": F.col("pre"), "far_post": F.col("post")})
    flow = F.col("far_pre") * (F.col("all_post") - F.col("far_post")) + F.col("far_post") * (F.col("all_pre") - F.col("far_pre"))
    flows = checkpointed(may.join(sums, ["id", "node"]).withColumn("own", flow))
    kids = flows.where("parent is not null").groupBy("id", F.col("parent").alias("node")).agg(F.max("own").alias("kids_flow"))
    flows = flows.join(kids, ["id", "node"], "left").withColumn("flow", F.when((F.col("kids") > 1) & F.col("parent").isNotNull(), F.col("kids_flow")).otherwise(F.col("own")))
    flows = checkpointed(flows.select("id", "node", "parent", "pre", "post", "flow"))
    peaks = flows.groupBy("id").agg(F.max("flow").alias("peak"))
    flows = checkpointed(flows.join(peaks, "id").withColumn("linker", (F.col("peak") > 0) & (F.col("flow") >= F.col("peak") * flow_share)))
    above = flows.select("id", F.col("node").alias("parent"), F.col("linker").alias("_cut"))
    loose = flows.where("not linker").join(above, ["id", "parent"], "left")
    parts = climbed(loose.select("id", "node", F.when(~F.col("_cut"), F.col("parent")).alias("up")), {}).withColumnRenamed("top", "part")
    loose = checkpointed(loose.join(parts, ["id", "node"]))
    by_part = loose.groupBy("id", "part").agg(F.sum("pre").alias("n_pre"), F.sum("post").alias("n_post"))
    totals = by_part.groupBy("id").agg(F.sum("n_pre").alias("t_pre"), F.sum("n_post").alias("t_post"))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    told = by_part.join(totals, "id").withColumns({"f_pre": share("n_pre", "t_pre"), "f_post": share("n_post", "t_post")})
    # Without inputs the quotient is without bound, which is axon.
    axon = (F.col("f_post") == 0) | (F.col("f_pre") / F.col("f_post") >= ratio)
    verdict = F.when(F.greatest("f_pre", "f_post") >= LEAST_SHARE, F.when(axon, "axon").otherwise("dendrite"))
    told = told.select("id", "part", verdict.alias("compartment"))
    labels = loose.join(told, ["id", "part"]).select("id", "node", "compartment").union(flows.where("linker").select("id", "node", F.lit("linker")))
    labels = checkpointed(labels)
    for label in ("axon", "dendrite"):
        labels = reunited(tour, labels, label)
    links = flows.where("parent is not null").select("id", "node", F.col("parent").alias("near"))
    links = checkpointed(links.union(links.select("id", "near", "node")))
    labels = unassigned_nearest(links, labels)
    out = held.select("id", "node").join(every.select("id", "status"), "id").join(flows.select("id", "node", "flow", "peak"), ["id", "node"], "left").join(labels, ["id", "node"], "left")
    still = F.when((F.col("status") == "ok") & (F.coalesce("peak", F.lit(0)) == 0), "no synapses").otherwise(F.col("status"))
    return out.select("id", "node", F.when(F.col("peak") > 0, F.col("compartment")).alias("compartment"), "flow", still.alias("status"))


def segregation(split: DataFrame, synapses: DataFrame) -> DataFrame:
    """(id, pre_axon, post_axon, pre_dendrite, post_dendrite, segregation): 1 where outputs and inputs lie apart, 0 where both compartments mix them alike.

    One less the mean entropy of the compartments, by synapses, over that of both together; 0 where that is 0, null without synapses in either.
    """
    met = synapses.join(split.where("status = 'ok'").select("id", "node", "compartment"), ["id", "node"])
    n = lambda c, p: F.count_if((F.col("compartment") == c) & (F.col("polarity") == p)).alias(f"{p}_{c}")
    sums = met.groupBy("id").agg(*[n(c, p) for c in ("axon", "dendrite") for p in ("pre", "post")])

    def entropy(a: Column, b: Column) -> Column:
        p = b / (a + b)
        return F.when((a > 0) & (b > 0), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)

    pa, oa, pd, od = (F.col(c) for c in ("pre_axon", "post_axon", "pre_dendrite", "post_dendrite"))
    every, whole = pa + oa + pd + od, entropy(pa + pd, oa + od)
    mixed = ((pa + oa) * entropy(pa, oa) + (pd + od) * entropy(pd, od)) / every
    return sums.withColumn("segregation", F.when(every > 0, F.when(whole > 0, 1 - mixed / whole).otherwise(0.0)))
