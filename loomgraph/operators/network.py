"""Networks: an edge table (source, target, weight) and what is computed on it by joins.

Iterative operators are driver loops over lazy joins. Each round's frontier or state is written to the shared folder, which cuts
the plan and survives lost executors, and the one before is deleted; only counts and norms reach the driver. Loops end at their fixpoint. Edges are bucketed once by the end
from which rounds come to them, or read from an EdgeStore, so no round moves them. Joins on hubs are plain equi-joins, which
adaptive execution splits where they are skewed, and sums are combined before they are shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed, clustered, forget, measured, percentiles, running
from loomgraph.operators import walks
from loomgraph.sources.edges import EdgeStore


def build(edges: DataFrame, source: str, target: str, weight: str | None = None, aggregate: bool = True, min_weight: float | None = None, directed: bool = True) -> DataFrame:
    """(source, target, weight, edges): parallel edges are summed; edges with a missing end are dropped."""
    w = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)
    a, b = F.col(source), F.col(target)
    ends = edges.where(a.isNotNull() & b.isNotNull())
    ends = ends.select((a if directed else F.least(a, b)).alias("source"), (b if directed else F.greatest(a, b)).alias("target"), w.alias("weight"))
    if aggregate:
        ends = ends.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))
    return ends.where(F.col("weight") >= min_weight) if min_weight is not None else ends


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (a, b), a < b, without loops."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree, in_weight, out_weight, strength) in one aggregation over both ends."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0).alias("iw"))
    ends = ends.union(edges.select(F.col("target").alias("id"), F.lit(0), F.lit(1), F.lit(0), F.col("weight")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))
    return sums.withColumns({"degree": F.col("in_degree") + F.col("out_degree"), "strength": F.col("in_weight") + F.col("out_weight")})


def triangles(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering): undirected; clustering is null below two neighbours.

    Each edge points from the end of smaller degree to the other, so the wedges closed at a node number at most the root of
    the edge count for each edge, and hubs have few of them.
    """
    pairs = simple(edges)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    ranked = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = arcs.toDF("u", "v").join(arcs.toDF("u", "w"), "u").where("v < w")
    closed = wedges.join(pairs.toDF("v", "w"), ["v", "w"], "left_semi")
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = degree.join(corners, "id", "left").select("id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return out.withColumn("clustering", F.when(F.col("degree") >= 2, F.col("triangles") / possible))


def digest(df: DataFrame, *columns: str) -> tuple:
    """Number of rows, sum and exclusive or of their hashes: equal for equal contents, in one pass."""
    h = F.xxhash64(*columns)
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


#: Rounds of components that go by ids before hashes take turns.
BY_IDS = 2


def components(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, component, size): component counts from 1, largest first, ties by least id.

    Each round contracts every node into the least of its neighbourhood and keeps the edges that are left, so a round has the edges of a smaller graph and not all of them.
    Two rounds go by the ids, which flattens trees whose ids ascend; of the later ones every other goes by hashes, which leaves three quarters of the nodes at most on average, whatever the graph.
    """
    pairs, rows = measured(simple(edges), n=F.count("*"))
    into: list[DataFrame] = []
    while rows["n"] or not into:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(len(into))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        if len(into) < BY_IDS or len(into) % 2:
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        else:
            least = both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select("a", F.least(drawn("a"), "m")["v"].alias("m"))
        into.append(checkpointed(least))
        ends = pairs.join(into[-1].withColumnRenamed("m", "source"), "a").join(into[-1].toDF("b", "target"), "b")
        after, rows = measured(simple(ends), n=F.count("*"))
        forget(pairs)
        pairs = after
    roots = into[-1]
    for k, step in enumerate(reversed(into[:-1]), 1):
        roots = step.join(roots.select(F.col("a").alias("m"), F.col("m").alias("root")), "m", "left").select("a", F.coalesce("root", "m").alias("m"))
        roots = checkpointed(roots) if k % 4 == 0 else roots
    if len(into) > BY_IDS:
        roots = checkpointed(roots)
        roots = roots.join(roots.groupBy("m").agg(F.min("a").alias("least")), "m").select("a", F.col("least").alias("m"))
    roots = roots.toDF("id", "root")
    if members is not None:
        rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    else:
        roots = checkpointed(roots)
        alone = nodes(edges.where("source = target or source is null or target is null")).join(roots, "id", "left_anti")
        rooted = roots.union(alone.select("id", F.col("id").alias("root")))
    rooted = checkpointed(rooted.select("id", "root"))
    forget(pairs, *into)
    sizes = rooted.groupBy("root").agg(F.count("*").alias("size"))
    # Most components of a sparse graph have one size, so they are numbered over ranges and not by size.
    numbered = running(sizes, [F.col("size").desc(), F.col("root")], name="_at")
    return rooted.join(numbered.select("root", "size", (F.col("_at") + 1).alias("component")), "root").select("id", "component", "size")


#: Rounds of one written state: chains take as many rounds as half their length.
UNROLLED = 4


def coreness(edges: DataFrame) -> DataFrame:
    """(id, coreness): each node's value falls to the greatest h such that h neighbours have at least h, until none falls.

    Neighbours are counted by value before they are moved, so a hub sends few rows to the task that ranks them.
    """
    pairs = simple(edges)
    both = checkpointed(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    value = checkpointed(both.groupBy("a").agg(F.count("*").alias("k")))
    down = W.partitionBy("a").orderBy(F.col("kb").desc()).rowsBetween(W.unboundedPreceding, 0)
    while True:
        after = value.select("a", "k", F.col("k").alias("was"))
        for _ in range(UNROLLED):
            counts = both.join(after.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b").groupBy("a", "kb").agg(F.count("*").alias("n"))
            h = counts.select("a", F.least(F.sum("n").over(down), F.col("kb")).alias("h")).groupBy("a").agg(F.max("h").alias("h"))
            after = after.join(h, "a").select("a", F.least("k", "h").alias("k"), "was")
        after = checkpointed(after)
        value = after.select("a", "k")
        if after.where("k < was").isEmpty():
            return value.toDF("id", "coreness")


def summary(edges: DataFrame, members: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """One row of twenty columns about a network whose nodes are the ends of edges, or members (id) where isolated ones count.

    Density and reciprocity count distinct ordered pairs without loops (unordered ones if undirected, and then no reciprocity). Clustering,
    transitivity and assortativity are those of the undirected simple graph. What has nothing to divide by is null.
    """
    edges = checkpointed(edges.select("source", "target", F.col("weight").cast("double").alias("weight")))
    ids = checkpointed(members.select("id").distinct() if members is not None else nodes(edges))
    n = F.col("nodes")
    arcs = checkpointed(edges.where("source <> target").select("source", "target").distinct())
    back = arcs.join(arcs.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"], "left_semi").agg(F.count("*").alias("mutual"))
    loops = F.count(F.when(F.col("source") == F.col("target"), 1))
    whole = edges.agg(F.count("*").alias("links"), loops.alias("self_loops"), F.sum("weight").alias("total_weight"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"))
    degree = checkpointed(ids.join(degrees(edges).select("id", "degree"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")))
    by_degree = degree.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    found = components(edges, ids).groupBy("component").agg(F.first("size").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest_component"))
    tri = checkpointed(triangles(edges))
    t = tri.agg(F.sum("triangles").alias("corners"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"), F.avg("clustering").alias("mean_clustering"))
    pairs = simple(edges).join(tri.select(F.col("id").alias("a"), F.col("degree").cast("double").alias("x")), "a").join(tri.select(F.col("id").alias("b"), F.col("degree").cast("double").alias("y")), "b")
    ends = pairs.agg(F.count("*").alias("pairs"), F.avg((F.col("x") + F.col("y")) / 2).alias("mx"), F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg((F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2).alias("xx"))
    frames = [by_degree, whole, arcs.agg(F.count("*").alias("arcs")), back, found, t, ends]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # frames of one row
    for df, column, name in ((degree, "degree", "median_degree"), (edges, "weight", "median_weight")):
        half = percentiles(df, column, [0.5]).select(F.col("q")[0].alias(name))
        one = one.join(F.broadcast(half), F.lit(True), "left")  # one row at most
    possible = n * (n - 1) if directed else n * (n - 1) / 2
    spread = F.col("xx") - F.col("mx") * F.col("mx")
    return one.select(
        "nodes", "links", F.lit(directed).alias("directed"), "self_loops", F.greatest(F.lit(0), F.col("links") - F.col("self_loops") - F.col("arcs")).alias("parallel_links"), "isolated",
        F.try_divide(F.col("arcs") if directed else F.col("pairs"), possible).alias("density"), "mean_degree", "median_degree", "max_degree",
        (F.try_divide("mutual", "arcs") if directed else F.lit(None).cast("double")).alias("reciprocity"), "components", "largest_component", "mean_clustering",
        F.try_divide("corners", "wedges").alias("transitivity"), F.when(spread > 1e-12, (F.col("xy") - F.col("mx") * F.col("mx")) / spread).alias("assortativity"),
        F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"), "mean_weight", "median_weight", "max_weight",
    )


def filtered(edges: DataFrame, seeds: DataFrame, expand: str = "none", hops: int = 1, direction: str = "any") -> DataFrame:
    """The edges among seeds (id) and what they are expanded to: none, hops along a direction, or whole components."""
    reached = seeds.select("id").distinct()
    if expand == "component":
        whole = components(edges)
        reached = whole.join(whole.join(reached, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id")
    elif expand == "hops":
        reached = reach(edges, reached, hops, direction).select("id")
    reached = checkpointed(reached)
    return edges.join(reached.withColumnRenamed("id", "source"), "source", "left_semi").join(reached.withColumnRenamed("id", "target"), "target", "left_semi")


Edges = DataFrame | EdgeStore


def arcs_from(edges: Edges, direction: str) -> list[DataFrame]:
    """(near, far, source, target, weight) in buckets by near, for each way that direction allows: outputs, inputs or both."""
    ways = {"outputs": ["outputs"], "inputs": ["inputs"], "both": ["outputs", "inputs"]}[direction]
    if isinstance(edges, EdgeStore):
        return [edges.arcs(way) for way in ways]
    ends = {"outputs": ("source", "target"), "inputs": ("target", "source")}
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1).alias("weight")
    return [clustered(edges.select(F.col(ends[w][0]).alias("near"), F.col(ends[w][1]).alias("far"), "source", "target", weight), ["near"]) for w in ways]


def done_with(edges: Edges, arcs: list[DataFrame]) -> None:
    """Deletes arcs unless they are a store's."""
    if not isinstance(edges, EdgeStore):
        forget(*arcs)


def reach(edges: Edges, seeds: DataFrame, hops: int, direction: str = "downstream") -> DataFrame:
    """(id, hop): every node within hops of the seeds, at its least distance."""
    arcs = arcs_from(edges, {"downstream": "outputs", "upstream": "inputs", "any": "both"}[direction])
    front = checkpointed(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    seen = front
    for hop in range(1, hops + 1):
        ids = front.select(F.col("id").alias("near"))
        met = reduce(lambda a, b: a.union(b), [side.join(ids, "near", "left_semi").select(F.col("far").alias("id")) for side in arcs])
        front, rows = measured(met.distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), n=F.count("*"))
        if not rows["n"]:
            break
        seen = seen.union(front)
    done_with(edges, arcs)
    return seen


def connectivity(edges: Edges, seeds: DataFrame, hops: int = 1, direction: str = "outputs", min_weight: float = 0, normalize_by: str | None = None) -> DataFrame:
    """(source, target, weight, hop, direction [, weight_total, weight_norm]): edges met by a breadth-first search.

    An edge keeps the hop at which it is first seen; seen both ways in that hop, its direction is both. min_weight prunes
    edges and what lies behind them. Normalising divides by all of an end's weight, before pruning; without any there is no
    fraction.
    """
    ways = ["outputs", "inputs"] if direction == "both" else [direction]
    arcs = arcs_from(edges, direction)
    front = checkpointed(seeds.select("id").distinct())
    seen, found = front, []
    for hop in range(1, hops + 1):
        ids = front.select(F.col("id").alias("near"))
        sides = [side.where(F.col("weight") >= min_weight).join(ids, "near", "left_semi").select("source", "target", "weight", F.lit(way).alias("direction"), "far") for way, side in zip(ways, arcs)]
        met = checkpointed(reduce(lambda a, b: a.union(b), sides).withColumn("hop", F.lit(hop)))
        found.append(met)
        front, rows = measured(met.select(F.col("far").alias("id")).distinct().join(seen, "id", "left_anti"), n=F.count("*"))
        if not rows["n"]:
            break
        seen = seen.union(front)
    every = reduce(lambda a, b: a.union(b), found)
    first = every.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min("hop").alias("hop"), F.min(F.struct("hop", "direction")).alias("a"), F.collect_set(F.struct("hop", "direction")).alias("s"))
    at_first = F.size(F.filter("s", lambda x: x["hop"] == F.col("a.hop")))
    out = first.select("source", "target", "weight", "hop", F.when(at_first > 1, "both").otherwise(F.col("a.direction")).alias("direction"))
    if normalize_by:
        end = "target" if normalize_by == "postsynaptic" else "source"
        whole = (edges.by_target if end == "target" else edges.by_source) if isinstance(edges, EdgeStore) else edges
        totals = whole.groupBy(end).agg(F.sum("weight").alias("weight_total"))
        out = out.join(totals, end, "left").withColumn("weight_norm", F.when(F.col("weight_total") > 0, F.col("weight") / F.col("weight_total")))
        out = out.select("source", "target", "weight", "hop", "direction", "weight_total", "weight_norm")
    return out


def collapsed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, target, weight, pairs) among labels (id, label): edges whose ends are called alike are summed; ids without a label stand for themselves, as text."""
    for end in ("source", "target"):
        named = labels.select(F.col("id").alias(end), F.col("label").alias("_label"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("_label", F.col(end).cast("string"))).drop("_label")
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("pairs"))


def paths(
    edges: Edges, sources: DataFrame, targets: DataFrame, max_hops: int, top: int, min_weight: float = 0,
    labels: DataFrame | None = None, normalize_by: str | None = None, rank_by: str = "weight", min_fraction: float = 0,
) -> DataFrame:
    """(path, hops, bottleneck [, bottleneck_norm], rank): the top simple paths by their least weight, then hops, then nodes.

    With labels (id, label) the search is among labels: edges are summed by the labels of their ends before anything is pruned, so a path of types need not be one of
    neurons. normalize_by (postsynaptic or presynaptic) divides each edge by all that its target receives, or its source sends; rank_by="fraction" ranks by
    the least of these. An edge without such a total has no fraction; min_fraction keeps it, and paths over it rank below all others.

    Only edges that lie on some short enough walk are joined: nodes are bounded by their distance from the sources and
    to the targets first. After each hop, paths that cannot rank any more are cut: top finished paths of a bottleneck
    at least as great exist already.
    """
    given = edges.by_source if isinstance(edges, EdgeStore) else edges
    if labels is not None:
        given = checkpointed(collapsed(given, labels))
        name = lambda df: df.select("id").join(labels.select("id", "label"), "id", "left").select(F.coalesce("label", F.col("id").cast("string")).alias("id")).distinct()
        sources, targets = checkpointed(name(sources)), checkpointed(name(targets))
    norm = F.lit(None).cast("double")
    held = given.select("source", "target", "weight")
    if normalize_by:
        end = "target" if normalize_by == "postsynaptic" else "source"
        totals = held.groupBy(end).agg(F.sum("weight").alias("_total")).where("_total > 0")
        held, norm = held.join(totals, end, "left"), F.col("weight") / F.col("_total")
    if normalize_by is None and labels is None:
        strong = edges
        fit = (F.col("weight") >= min_weight) & (F.col("source") != F.col("target"))
        if not isinstance(edges, EdgeStore):
            strong = edges.where(fit)
    else:
        held = held.withColumn("norm", norm)
        held = checkpointed(held.where((F.col("weight") >= min_weight) & (F.col("source") != F.col("target")) & (F.col("norm").isNull() | (F.col("norm") >= min_fraction))))
        strong, fit = held, F.lit(True)
    if isinstance(strong, EdgeStore):
        strong = checkpointed(strong.by_source.where(fit)) if min_weight > 0 else strong
    ahead = reach(strong, sources, max_hops, "downstream").withColumnRenamed("hop", "d")
    back = reach(strong, targets, max_hops, "upstream").withColumnRenamed("hop", "e")
    useful = checkpointed(ahead.join(back, "id").where(F.col("d") + F.col("e") <= max_hops))
    table = (strong.by_source if isinstance(strong, EdgeStore) else strong).where(F.col("source") != F.col("target"))
    if "norm" not in table.columns:
        table = table.withColumn("norm", norm)
    arcs = table.join(useful.select(F.col("id").alias("source")), "source", "left_semi").join(useful.select(F.col("id").alias("target"), "e"), "target")
    arcs = clustered(arcs.groupBy("source", "target").agg(F.sum("weight").alias("w"), F.sum("norm").alias("n"), F.first("e").alias("e")), ["source"])
    goal = targets.select(F.col("id").alias("last")).distinct()
    # A path with one unmeasured edge has no fraction; greater than all is what it starts from.
    walk = sources.select(F.col("id").alias("last")).distinct().withColumns({"path": F.array("last"), "bottleneck": F.lit(float("inf")), "bottleneck_norm": F.lit(float("inf"))})
    by = "bottleneck_norm" if rank_by == "fraction" else "bottleneck"
    order = [F.col(by).desc_nulls_last(), F.col("hops"), F.col("path")]
    best = None
    for hop in range(1, max_hops + 1):
        met = walk.join(arcs, walk["last"] == arcs["source"]).where((F.col("e") <= max_hops - hop) & ~F.array_contains("path", F.col("target")))
        least = F.when(F.col("n").isNotNull() & F.col("bottleneck_norm").isNotNull(), F.least("bottleneck_norm", "n"))
        walk = checkpointed(met.select(F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path"), F.least("bottleneck", F.col("w").cast("double")).alias("bottleneck"), least.alias("bottleneck_norm")))
        done = walk.join(goal, "last", "left_semi").select("path", F.lit(hop).alias("hops"), "bottleneck", "bottleneck_norm")
        best = checkpointed((done if best is None else best.union(done)).orderBy(*order).limit(top))
        n, measured_, floor = best.agg(F.count("*"), F.count(by), F.min(by)).first()
        if n >= top and measured_ == n:
            walk = walk.where(F.col(by) >= floor)
    out = best.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # at most top rows
    return out.select("path", "hops", "bottleneck", *(["bottleneck_norm"] if normalize_by else []), "rank")


#: What is added to a logarithm of influence, whose least magnitude is its negative exponential: a published constant, under which scores compare.
LOG_SHIFT = 24


def influence(edges: DataFrame, seeds: DataFrame, max_hops: int, gain: float = 1.0, direction: str = "outputs", by_seed: bool = False, share_mass: bool = False, keep: int | None = None) -> DataFrame:
    """([seed_id,] id, influence, influence_log, hops, seed): s + gWs + g²W²s + ..., W being weights divided by each receiving node's total.

    Mass spreads from a node at every hop, not only the first; loops count. hops is the first at which a node has mass, seed whether it had any to begin with: 1 each, or
    with share_mass equal parts of 1. by_seed keeps the seeds apart: the scores of a node then add up to its score without. influence_log is the logarithm, shifted by LOG_SHIFT and not
    below 0. keep lets only so many nodes of greatest mass go on from each hop (ties to the lesser id); influence_lost says what that costs.
    """
    return spread(edges, seeds, max_hops, gain, direction, by_seed, share_mass, keep)[0]


def spread(edges: DataFrame, seeds: DataFrame, max_hops: int, gain: float = 1.0, direction: str = "outputs", by_seed: bool = False, share_mass: bool = False, keep: int | None = None) -> tuple[DataFrame, list[dict]]:
    """influence, and for each hop its mass and the mass that ``keep`` held back."""
    arcs = edges.select("source", "target", "weight") if direction == "outputs" else edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    total = arcs.groupBy("target").agg(F.sum("weight").alias("total"))
    w = clustered(arcs.join(total, "target").where("total > 0").select("source", "target", (F.col("weight") / F.col("total")).alias("w")), ["source"])
    who = ["seed_id"] if by_seed else []
    start = seeds.select("id").distinct()
    one = 1.0 / max(1, start.count()) if share_mass else 1.0
    mass = checkpointed(start.select(*[F.col("id").alias(c) for c in who], "id", F.lit(one).alias("m")))
    parts, lost = [mass.withColumn("hop", F.lit(0))], []
    for hop in range(1, max_hops + 1):
        going = mass
        if keep is not None:
            # A node goes on with all its seeds' mass, or not at all.
            greatest = mass.groupBy("id").agg(F.sum("m").alias("_m")).orderBy(F.col("_m").desc(), "id").limit(keep).select("id")
            going = mass.join(greatest, "id", "left_semi")
        whole, gone = mass.agg(F.sum("m")).first()[0] or 0.0, going.agg(F.sum("m")).first()[0] or 0.0
        lost.append({"hop": hop, "mass": whole, "held_back": whole - gone if keep is not None else 0.0})
        mass = checkpointed(going.join(w, going["id"] == w["source"]).groupBy(*who, F.col("target")).agg(F.sum(F.col("m") * F.col("w") * gain).alias("m")).withColumnRenamed("target", "id"))
        parts.append(mass.withColumn("hop", F.lit(hop)))
    every = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*who, "id").agg(F.sum("m").alias("influence"), F.min("hop").alias("hops"))
    log = F.when(F.col("influence") == 0, 0.0).otherwise(F.log(F.greatest(F.col("influence"), F.lit(2.718281828459045**-LOG_SHIFT))) + LOG_SHIFT)
    flag = F.col("hops") == 0
    return every.select(*who, "id", "influence", log.alias("influence_log"), "hops", flag.alias("seed")), lost


def unwalked(last_mass: float, gain: float) -> float | None:
    """What hops beyond the last could still add in all, where a gain below 1 bounds it: outputs of a hop are at most gain times its inputs when walked along inputs."""
    return last_mass * gain / (1 - gain) if gain < 1 else None


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, weighted: bool = True, directed: bool = True) -> DataFrame:
    """(id, pagerank): from 1/n; loops skipped, weights that aren't positive count 1, the mass of nodes without outgoing edges goes to all alike."""
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0) if weighted else F.lit(1.0)
    arcs = edges.where("source <> target").select("source", "target", w.alias("w"))
    if not directed:
        arcs = arcs.union(arcs.select(F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    ids = checkpointed(nodes(edges))
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    arcs = arcs.groupBy("source", "target").agg(F.sum("w").alias("w"))
    out = arcs.groupBy("source").agg(F.sum("w").alias("total"))
    shares = clustered(arcs.join(out, "source").select("source", "target", (F.col("w") / F.col("total")).alias("p")), ["source"])
    dangling = ids.join(shares.select(F.col("source").alias("id")).distinct(), "id", "left_anti").withColumn("lost", F.lit(True))
    gone = F.coalesce(F.sum(F.when(F.col("lost"), F.col("r"))), F.lit(0.0))
    rank, seen = measured(ids.join(dangling, "id", "left").select("id", F.coalesce("lost", F.lit(False)).alias("lost"), F.lit(1.0 / n).alias("r")), lost=gone)
    for _ in range(rounds):
        sent = rank.join(shares, rank["id"] == shares["source"]).groupBy("target").agg(F.sum(F.col("r") * F.col("p")).alias("s"))
        new = (1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + seen["lost"] / n)
        after, seen = measured(rank.join(sent, rank["id"] == sent["target"], "left").select("id", "lost", new.alias("r"), F.abs(new - F.col("r")).alias("change")), lost=gone, change=F.sum("change"))
        forget(rank)
        rank = after
        if seen["change"] < tolerance * n:
            break
    return rank.select("id", F.col("r").alias("pagerank"))


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, eigenvector): undirected power iteration on A + I, scaled to length 1."""
    both = edges.select("source", "target", F.col("weight").cast("double").alias("w")).union(edges.select(F.col("target"), F.col("source"), F.col("weight").cast("double")))
    arcs = clustered(both.where("source <> target").groupBy("source", "target").agg(F.sum("w").alias("w")), ["source"])
    x = checkpointed(nodes(edges).withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        sent = x.join(arcs, x["id"] == arcs["source"]).groupBy("target").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
        raw, seen = measured(x.join(sent, x["id"] == sent["target"], "left").select("id", "x", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y")), norm=F.sqrt(F.sum(F.col("y") * F.col("y"))))
        norm = seen["norm"] or 1.0
        scaled = raw.select("id", (F.col("y") / norm).alias("x"), F.abs(F.col("y") / norm - F.col("x")).alias("change"))
        change = scaled.agg(F.sum("change")).first()[0] or 0.0
        x = scaled.select("id", "x")
        if change < tolerance:
            break
    return x.toDF("id", "eigenvector")


#: Rows (a node and block of sources) that a round of walks by joins may write: more sources go out in turns.
AT_ONCE = 20_000_000


def in_bundles(both: DataFrame, links: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(id, bundle), the nodes that a task is to hold together in walks, None if it holds all; and those (id) of components that are too large for a task, None without such."""
    if links <= walks.MOST_LINKS:
        return None, None
    found = checkpointed(components(both).select("id", "component"))
    sizes = both.join(found.withColumnRenamed("id", "source").hint("merge"), "source").groupBy("component").agg(F.count("*").alias("links"))
    bins = -(-2 * links // walks.MOST_LINKS)
    small = F.when(F.col("links") > walks.MOST_LINKS // 64, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bins)))
    bundle = F.when(F.col("links") <= walks.MOST_LINKS, small).cast("long")
    of, seen = measured(found.join(sizes.hint("merge"), "component").select("id", bundle.alias("bundle")), large=F.count_if(F.col("bundle").isNull()))
    forget(found)
    return of.where("bundle is not null"), of.where("bundle is null").select("id") if seen["large"] else None


def closeness(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, reached, closeness) for each source: nodes it reaches (within max_hops), and reached over the sum of distances, undirected and unweighted.

    Components that fit a task are walked there, a bit a node and source; in larger ones sources go out 64 at a time by joins: a row a node and 64 sources.
    """
    both, seen = measured(both_ways(edges).where("source <> target").distinct(), links=F.count("*"))
    asked = checkpointed(sources.select("id").where("id is not null").distinct())
    of, large = in_bundles(both, seen["links"])

    def work(links: walks.Links, own: np.ndarray) -> dict[str, np.ndarray]:
        reached, far = walks.distances(links, own, max_hops)
        at = reached > 0
        return {"id": own[at], "reached": reached[at], "far": far[at]}

    told = walks.in_tasks(both, asked, of, work, f"id {dict(both.dtypes)['source']}, reached long, far long")
    if large is not None:
        told = told.union(distances_by_joins(both, asked, large, max_hops))
    return told.select(F.col("id").cast(dict(sources.dtypes)["id"]).alias("id"), "reached", (F.col("reached") / F.col("far")).alias("closeness"))


def of_large(both: DataFrame, asked: DataFrame, large: DataFrame, lanes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The links of both among large (id), in buckets, and asked (id) of them with _at, their numbers, in turns in which a round writes AT_ONCE rows at most, if it has lanes sources a row."""
    held = clustered(both.join(large.select(F.col("id").alias("source")).hint("merge"), "source", "left_semi"), ["source"])
    placed = checkpointed(running(asked.join(large.hint("merge"), "id", "left_semi"), [F.col("id")], name="_at"))
    turn = lanes * max(1, AT_ONCE // max(1, large.count()))
    return held, [placed.where((F.col("_at") >= at) & (F.col("_at") < at + turn)) for at in range(0, placed.count(), turn)]


def distances_by_joins(both: DataFrame, asked: DataFrame, large: DataFrame, max_hops: int | None) -> DataFrame:
    """(id, reached, far) of the sources asked (id) that lie in large (id): nodes within max_hops, and the sum of their distances."""
    both, turns = of_large(both, asked, large, 64)
    parts = [F.lit(0).cast("long").alias(c) for c in ("reached", "far")]
    parts = [asked.limit(0).select("id", *parts)]
    block, bit = F.shiftright("_at", 6), F.col("_at").bitwiseAND(F.lit(63)).cast("int")
    for placed in turns:
        seen = checkpointed(placed.select(F.col("id").alias("at"), block.alias("block"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("bits")))
        front, sums, states = seen, [], [seen]
        for hop in count(1) if max_hops is None else range(1, max_hops + 1):
            met = front.join(both, front["at"] == both["source"]).groupBy(F.col("target").alias("at"), "block").agg(F.bit_or("bits").alias("met"))
            every = seen.join(met, ["at", "block"], "full_outer").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("bits", "met")})
            new = F.col("met").bitwiseAND(F.bitwise_not("bits"))
            after, rows = measured(every.select("at", "block", F.col("bits").bitwiseOR(F.col("met")).alias("bits"), new.alias("new")), new=F.count_if(F.col("new") != 0))
            forget(*states)
            states = [after]
            if not rows["new"]:
                break
            fresh = after.where("new <> 0")
            sums.append(checkpointed(fresh.groupBy("block").agg(*[F.sum(F.getbit("new", F.lit(k)).cast("long")).alias(f"n{k}") for k in range(64)]).withColumn("hop", F.lit(hop))))
            seen, front = after.select("at", "block", "bits"), fresh.select("at", "block", F.col("new").alias("bits"))
        forget(*states)
        if not sums:
            continue
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.col(f"n{k}").alias("n")) for k in range(64)]))
        told = reduce(lambda a, b: a.union(b), sums).select("block", "hop", each.alias("e")).where("e.n > 0")
        told = told.groupBy("block", "e.bit").agg(F.sum("e.n").alias("reached"), F.sum(F.col("e.n") * F.col("hop")).alias("far"))
        parts.append(checkpointed(placed.select("id", block.alias("block"), bit.alias("bit")).join(told, ["block", "bit"]).select("id", "reached", "far")))
        forget(*sums)
    forget(both)
    return reduce(lambda a, b: a.union(b), parts)


def layers(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(id, layer): the longest number of steps from the roots along edges, at most ``most`` (cycles stop there)."""
    arcs = clustered(edges.where("source <> target").select("source", "target").distinct(), ["source"])
    layer = checkpointed(roots.select("id").distinct().withColumn("layer", F.lit(0)))
    for k in range(1, most + 1):
        front = layer.where(F.col("layer") == k - 1).select(F.col("id").alias("source"))
        pushed = arcs.join(front, "source", "left_semi").select(F.col("target").alias("id")).distinct().withColumn("layer", F.lit(k))
        after, seen = measured(layer.union(pushed).groupBy("id").agg(F.max("layer").alias("layer")), pushed=F.count_if(F.col("layer") == k))
        forget(layer)
        layer = after
        if not seen["pushed"]:
            break
    forget(arcs)
    return layer


def motif(
    edges: DataFrame, pattern: list[tuple[str, str]], absent: list[tuple[str, str]] = (), attributes: DataFrame | None = None,
    nodes_where: dict[str, str] | None = None, edges_where: dict[tuple[str, str], str] | None = None,
) -> DataFrame:
    """One row a match, a column a node of pattern: all its edges exist between distinct nodes, and none of absent.

    nodes_where has conditions on the attributes (id and more) of nodes by their name in the pattern, edges_where such on the columns of edges, as SQL; an absent edge
    with a condition may exist if it doesn't meet it. What a condition rules out is left out before anything is joined. The pattern must hang together: each of
    its edges is joined on nodes that are placed already.
    """
    nodes_where, edges_where = nodes_where or {}, edges_where or {}

    def arcs_of(a: str, b: str) -> DataFrame:
        found = edges.where(edges_where[a, b]) if (a, b) in edges_where else edges
        found = found.select("source", "target").distinct().toDF(a, b)
        for name in (a, b):
            if name in nodes_where:
                found = found.join(attributes.where(nodes_where[name]).select(F.col("id").alias(name)).distinct(), name, "left_semi")
        return found.select(a, b)

    found, names, todo, order = None, [], list(pattern), []
    while todo:
        known = {x for e in order for x in e}
        following = next((e for e in sorted(todo, key=lambda e: -len(known & set(e))) if not order or known & set(e)), None)
        if following is None:
            raise ValueError(f"nothing links {todo[0]} to the rest of the pattern")
        order.append(following)
        todo.remove(following)
    for a, b in order:
        side = arcs_of(a, b)
        if found is None:
            found, names = side.where(F.col(a) != F.col(b)), [a, b]
            continue
        shared = [x for x in (a, b) if x in names]
        found = found.join(side, shared)
        for x in (a, b):
            if x not in names:
                found = found.where(reduce(lambda p, q: p & q, [F.col(x) != F.col(y) for y in names]))
                names.append(x)
    for a, b in absent:
        found = found.join(arcs_of(a, b), [a, b], "left_anti")
    return found.select(*dict.fromkeys(x for e in pattern for x in e))


#: Sources whose path counts share a row a node.
LANES = 32


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness) from shortest paths of the given sources, undirected and unweighted, scaled up to all nodes.

    Components that fit a task are walked there; in larger ones a row is a node and LANES sources, a column each. Path counts go out hop by hop; what depends on a node comes back hop by hop.
    """
    both, seen = measured(both_ways(edges).where("source <> target").distinct(), links=F.count("*"))
    ids = checkpointed(both.select(F.col("source").alias("id")).distinct())
    asked = checkpointed(ids.join(sources.select("id").distinct(), "id", "left_semi"))
    of, large = in_bundles(both, seen["links"])

    def work(links: walks.Links, own: np.ndarray) -> dict[str, np.ndarray]:
        gain = walks.dependencies(links, own)
        at = np.flatnonzero(gain)
        return {"id": at, "gain": gain[at]}

    found = walks.in_tasks(both, asked, of, work, f"id {dict(both.dtypes)['source']}, gain double")
    if large is not None:
        found = found.union(dependencies_by_joins(both, asked, large))
    n, k = ids.count(), max(1, asked.count())
    every = found.groupBy("id").agg(F.sum("gain").alias("gain"))
    return ids.join(every, "id", "left").select("id", (F.coalesce("gain", F.lit(0.0)) * (n / k / 2)).alias("betweenness"))


def dependencies_by_joins(both: DataFrame, asked: DataFrame, large: DataFrame) -> DataFrame:
    """(id, gain): what the shortest paths of the sources asked (id) that lie in large (id) add to each node."""
    both, turns = of_large(both, asked, large, LANES)
    lanes, at = range(LANES), ["block", "id"]
    own = [F.when(F.col("_at") % LANES == k, 1.0).otherwise(0.0).alias(f"p{k}") for k in lanes]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"p{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in lanes])
    parts = [asked.limit(0).withColumn("gain", F.lit(0.0))]
    for start in turns:
        ring = checkpointed(start.select(F.floor(F.col("_at") / LANES).alias("block"), "id", *own).withColumn("bits", bits))
        rings = []
        while True:
            rings.append(ring)
            seen = reduce(lambda a, b: a.union(b), [r.select(*at, "bits") for r in rings]).groupBy(*at).agg(F.bit_or("bits").alias("_seen"))
            met = ring.join(both, ring["id"] == both["source"]).groupBy("block", F.col("target").alias("id")).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in lanes])
            known = F.coalesce("_seen", F.lit(0).cast("long"))
            new = met.join(seen, at, "left").select(*at, *[F.when(known.bitwiseAND(F.lit(1 << k)) == 0, F.col(f"p{k}")).otherwise(0.0).alias(f"p{k}") for k in lanes])
            ring, rows = measured(new.withColumn("bits", bits).where("bits <> 0"), n=F.count("*"))
            if not rows["n"]:
                break
        gained, found = None, []
        for ring in reversed(rings[1:]):
            if gained is None:
                here = ring.select(*at, *[f"p{k}" for k in lanes], *[F.lit(0.0).alias(f"g{k}") for k in lanes])
            else:
                of = gained.select(*at, *[F.when(F.col(f"p{k}") > 0, (1 + F.col(f"g{k}")) / F.col(f"p{k}")).otherwise(0.0).alias(f"s{k}") for k in lanes])
                sums = of.join(both, of["id"] == both["source"]).groupBy("block", F.col("target").alias("id")).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in lanes])
                here = ring.join(sums, at, "left").select(*at, *[f"p{k}" for k in lanes], *[(F.col(f"p{k}") * F.coalesce(f"s{k}", F.lit(0.0))).alias(f"g{k}") for k in lanes])
            before, gained = gained, checkpointed(here)
            found.append(checkpointed(gained.groupBy("id").agg(F.sum(reduce(lambda a, b: a + b, [F.col(f"g{k}") for k in lanes])).alias("gain"))))
            forget(ring, *[before] if before is not None else [])
        if found:
            parts.append(checkpointed(reduce(lambda a, b: a.union(b), found).groupBy("id").agg(F.sum("gain").alias("gain"))))
        forget(rings[0], *[gained] if gained is not None else [], *found)
    forget(both)
    return reduce(lambda a, b: a.union(b), parts)


def moved_nodes(both: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(id, c) for both (source, target, w; each link both ways, loops once): nodes move to the neighbouring community of greatest modularity gain.

    In each round a seeded half of the nodes may move, seeing the others where they are; ties go to the least community.
    Ends when neither half gains, or when modularity has not risen for three rounds, with the best state seen.
    """
    strength = checkpointed(both.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("k")))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    loops = both.where("source = target").agg(F.sum("w")).first()[0] or 0.0
    at = checkpointed(strength.select("id", "k", F.col("id").alias("c")))
    best, best_at, still, flat, r = float("-inf"), at, 0, 0, 0
    change = at.limit(0).select(F.lit(False).alias("moved"))
    while True:
        sizes = at.groupBy("c").agg(F.sum("k").alias("size"))
        links = both.where("source <> target").join(at.select(F.col("id").alias("target"), F.col("c").alias("to")), "target").groupBy(F.col("source").alias("id"), "to").agg(F.sum("w").alias("w"))
        links = checkpointed(links)
        inner = links.join(at.select("id", F.col("c").alias("to")), ["id", "to"], "left_semi").agg(F.sum("w").alias("inner"))
        told = inner.crossJoin(sizes.agg(F.sum(F.col("size") * F.col("size")).alias("squares"))).crossJoin(change.agg(F.max("moved").alias("moved"))).first()  # frames of one row
        still = 0 if told.moved or r == 0 else still + 1
        quality = ((told.inner or 0.0) + loops) / total - resolution * (told.squares or 0.0) / total**2
        if quality > best + 1e-9:
            best, best_at, flat = quality, at, 0
        else:
            flat += 1
        if still >= 2 or flat >= 3:
            return best_at.select("id", "c")
        options = links.join(at.select("id", "k", "c"), "id").join(sizes.withColumnRenamed("c", "to"), "to")
        gain = F.col("w") - resolution * F.col("k") * (F.col("size") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total
        scored = options.select("id", "to", gain.alias("gain"))
        stay = at.join(links.select("id", F.col("to").alias("c"), "w"), ["id", "c"], "left").join(sizes, "c")
        stay = stay.select("id", F.col("c").alias("to"), (F.coalesce("w", F.lit(0.0)) - resolution * F.col("k") * (F.col("size") - F.col("k")) / total + 1e-12).alias("gain"))
        chosen = scored.union(stay).groupBy("id").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"))
        turn = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r // 2)), F.lit(2)) == r % 2
        after = checkpointed(at.join(chosen, "id").select("id", "k", F.when(turn, F.col("to")).otherwise(F.col("c")).alias("c"), (turn & (F.col("to") != F.col("c"))).alias("moved")))
        at, change = after.select("id", "k", "c"), after.select("moved")
        r += 1


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, community) by Louvain's levels: nodes move, communities become nodes, until nothing merges.

    Numbers count from 1, largest community first, ties by least id. Weights that aren't positive count 1; loops are skipped. Ids are integers.
    """
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    arcs = edges.where("source <> target").select("source", "target", w.alias("w"))
    both = checkpointed(arcs.union(arcs.select("target", "source", "w")).groupBy("source", "target").agg(F.sum("w").alias("w")))
    at = checkpointed(nodes(edges).select("id", F.col("id").alias("c")))
    while True:
        moved = checkpointed(moved_nodes(both, resolution, seed))
        if moved.where("id <> c").isEmpty():
            break
        at = checkpointed(at.join(moved.toDF("c", "into"), "c", "left").select("id", F.coalesce("into", "c").alias("c")))
        ends = both.join(moved.toDF("source", "a"), "source").join(moved.toDF("target", "b"), "target")
        both = checkpointed(ends.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("w").alias("w")))
    sizes = at.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    numbered = running(sizes, [F.col("n").desc(), F.col("first")], name="_at")
    return at.join(numbered, "c").select("id", (F.col("_at") + 1).alias("community"))


def match_types(labelled: DataFrame, datasets: int) -> tuple[DataFrame, DataFrame]:
    """(labels, report) from (dataset, id, label): types that the datasets call alike.

    A neuron may carry several labels; neurons and labels are the two sides of a graph whose components are the shared types. A component
    that holds neurons of all the datasets is matched. labels: dataset, id, type (the component's least label), matched.
    report: type, dataset, n_neurons, matched, suspicious (its datasets differ more than fivefold in neurons).
    """
    held = labelled.where(F.trim("label") != "").select("dataset", "id", "label").distinct()
    node = F.concat_ws("\x00", F.lit("n"), "dataset", F.col("id").cast("string"))
    edges = held.select(node.alias("source"), F.concat_ws("\x00", F.lit("l"), "label").alias("target"), F.lit(1).alias("weight"))
    found = components(edges).select("id", "component")
    typed = held.withColumn("node", node).join(found.withColumnRenamed("id", "node"), "node")
    names = typed.groupBy("component").agg(F.min("label").alias("type"), F.count_distinct("dataset").alias("_datasets"))
    sizes = typed.groupBy("component", "dataset").agg(F.count_distinct("id").alias("n_neurons"))
    spread = sizes.groupBy("component").agg((F.max("n_neurons") > 5 * F.min("n_neurons")).alias("suspicious"))
    names = names.join(spread, "component").withColumn("matched", F.col("_datasets") == datasets)
    labels = typed.select("dataset", "id", "component").distinct().join(names, "component").select("dataset", "id", "type", "matched")
    report = sizes.join(names, "component").select("type", "dataset", "n_neurons", "matched", (F.col("suspicious") & F.col("matched")).alias("suspicious"))
    return labels, report
