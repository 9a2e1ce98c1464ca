"""Joining the fragments of skeletons by their shortest bridges, after Borůvka.

In each round every fragment takes the shortest bridge to another of its skeleton, and fragments that bridges join are one from then on; so many rounds are needed as
the logarithm of the fragments, and no more bridges than a least spanning forest has. Nearest nodes of other fragments are found on a grid whose cells
double until somebody finds one: what lies in cells without another fragment around isn't compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed, forget, measured
from loomgraph.operators.trees import AXES, apart, climbed, rooted

_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def smallest(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, node, least) for members (id, node): the least node that links (id, a, b; a skeleton's own) reach."""
    labels = checkpointed(members.select("id", "node", F.col("node").alias("least")))
    both = checkpointed(links.select("id", "a", "b").union(links.select("id", "b", "a")))
    while True:
        # A label passes over a link, and then to where that label stands already.
        near = both.join(labels.select("id", F.col("node").alias("b"), "least"), ["id", "b"]).groupBy("id", F.col("a").alias("node")).agg(F.min("least").alias("_near"))
        hop = labels.join(near, ["id", "node"], "left").select("id", "node", F.least("least", F.coalesce("_near", "least")).alias("least"), F.col("least").alias("was"))
        jump = labels.select("id", F.col("node").alias("least"), F.col("least").alias("_further"))
        after, seen = measured(hop.join(jump, ["id", "least"], "left").select("id", "node", F.least("least", "_further").alias("least"), "was"), moved=F.count_if(F.col("least") < F.col("was")))
        forget(labels)
        labels = after.select("id", "node", "least")
        if not seen["moved"]:
            return labels


def shortest_bridges(spots: DataFrame, size: float) -> DataFrame:
    """(id, part, bridge) of spots (id, node, part, x, y, z): a part's shortest link of at most size to another part of its skeleton, as (d, a, b), a < b."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    held = spots.withColumns({f"g{c}": cell(c) for c in AXES})
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, AXES)]) for s in _AROUND])
    grid = ["id", *[f"g{c}" for c in AXES]]
    # Cells around which there is more than one part; only what lies there is compared.
    parts = held.select(*grid, "part").distinct()
    around = parts.select("id", "part", *[f"g{c}" for c in AXES], F.explode(steps).alias("s")).select("id", "part", *[(F.col(f"g{c}") + F.col(f"s.{c}")).alias(f"g{c}") for c in AXES])
    mixed = around.groupBy(*grid).agg(F.min("part").alias("_p"), F.max("part").alias("_q")).where("_p <> _q").select(*grid)
    # Sizes are told from before rows are repeated for the cells around, so Spark would take these for small and gather them in the driver.
    near = checkpointed(held.join(mixed.hint("merge"), grid, "left_semi"))
    looks = near.select("id", F.col("node").alias("a"), F.col("part").alias("p"), *[F.col(c).alias(f"a{c}") for c in AXES], *[f"g{c}" for c in AXES], F.explode(steps).alias("s"))
    looks = looks.select("id", "a", "p", "ax", "ay", "az", *[(F.col(f"g{c}") + F.col(f"s.{c}")).alias(f"g{c}") for c in AXES])
    met = looks.join(near.select(*grid, F.col("node").alias("b"), F.col("part").alias("q"), *[F.col(c).alias(f"b{c}") for c in AXES]).hint("merge"), grid).where("p <> q")
    d = apart("a", "b")
    bridge = F.struct(d.alias("d"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.where(d <= size).groupBy("id", F.col("p").alias("part")).agg(F.min(bridge).alias("bridge"))


def bridges(nodes: DataFrame, max_dist: float | None = None) -> DataFrame:
    """(id, a, b, distance): the links of a least spanning forest over the fragments of each skeleton, none longer than max_dist; ties go to the lesser nodes."""
    held = rooted(nodes)
    tops = climbed(held.select("id", "node", F.col("parent").alias("up")), {}).withColumnRenamed("top", "part")
    spots = checkpointed(held.select("id", "node", *AXES).join(tops, ["id", "node"]))
    box = spots.agg(*[(F.max(c) - F.min(c)).alias(c) for c in AXES]).first()
    widest = sum((box[c] or 0.0) ** 2 for c in AXES) ** 0.5
    most = widest if max_dist is None else min(widest, max_dist)
    links = held.where("parent is not null and step > 0").agg(F.avg("step")).first()[0]
    size, found = min(most, links or most or 1.0) or 1.0, []
    while True:
        many = spots.select("id", "part").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        loose = checkpointed(spots.join(many, "id", "left_semi"))
        if loose.isEmpty():
            break
        best, seen = measured(shortest_bridges(loose, size).select("id", "bridge.a", "bridge.b", "bridge.d").distinct(), n=F.count("*"))
        if not seen["n"]:
            if size >= most:
                break
            size = min(2 * size, most)
            continue
        found.append(best)
        of = lambda end: loose.select("id", F.col("node").alias(end), F.col("part").alias(f"part_{end}"))
        ends = checkpointed(best.join(of("a"), ["id", "a"]).join(of("b"), ["id", "b"]).select("id", F.col("part_a").alias("a"), F.col("part_b").alias("b")))
        merged = smallest(ends, loose.select("id", F.col("part").alias("node")).distinct())
        after = checkpointed(loose.join(merged.toDF("id", "part", "into"), ["id", "part"]).select("id", "node", F.col("into").alias("part"), *AXES))
        forget(spots, loose)
        spots = after
    none = held.select("id", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    return reduce(lambda p, q: p.union(q), [df.select("id", "a", "b", F.col("d").alias("distance")) for df in found], none)


def rerooted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, node, parent) for the ends of links (id, a, b), which make trees: parents as seen from roots (id, node), one a tree; roots have none.

    A tour round a tree passes each link twice, first away from the root. Its arcs are ranked by pointer doubling, so deep trees take few rounds.
    """
    both = checkpointed(links.select("id", F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("id", "b", "a")))
    turn = W.partitionBy("id", "u").orderBy("v")
    # Having come to v from u, the tour goes on to the neighbour of v behind u, or to its first; it ends where that would be the root's first again.
    order = both.select("id", F.col("u").alias("v"), F.col("v").alias("u"), F.lead("v").over(turn).alias("behind"), F.first("v").over(turn).alias("first"))
    ends = roots.select("id", F.col("node").alias("v"), F.lit(True).alias("at_root"))
    arc = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    order = order.join(ends, ["id", "v"], "left").withColumn("w", F.coalesce("behind", F.when(F.col("at_root").isNull(), F.col("first"))))
    ranks = climbed(order.select("id", arc("u", "v").alias("node"), F.when(F.col("w").isNotNull(), arc("v", "w")).alias("up")), {"rank": F.lit(1).cast("long")})
    ranks = checkpointed(ranks.select("id", "node.u", "node.v", "rank"))
    back = ranks.select("id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("rank").alias("_back"))
    down = ranks.join(back, ["id", "u", "v"]).where("rank > _back").select("id", F.col("v").alias("node"), F.col("u").alias("parent"))
    return down.union(roots.select("id", "node", F.lit(None).cast(dict(down.dtypes)["parent"])))


def healed(nodes: DataFrame, max_dist: float | None = None) -> DataFrame:
    """nodes with parents over the bridges between fragments: what bridges join is one tree under the root of its largest fragment (ties: the lesser root).

    max_dist leaves fragments further apart than this unjoined. No node is added, moved or dropped.
    """
    joined = checkpointed(bridges(nodes, max_dist))
    held = rooted(nodes)
    tops = checkpointed(climbed(held.select("id", "node", F.col("parent").alias("up")), {}))
    links = checkpointed(held.where("parent is not null").select("id", F.col("node").alias("a"), F.col("parent").alias("b")).union(joined.select("id", "a", "b")))
    ends = joined.select("id", "a", "b")
    of = lambda end: tops.select("id", F.col("node").alias(end), F.col("top").alias(f"top_{end}"))
    between = checkpointed(ends.join(of("a"), ["id", "a"]).join(of("b"), ["id", "b"]).select("id", F.col("top_a").alias("a"), F.col("top_b").alias("b")))
    whole = checkpointed(smallest(between, tops.select("id", F.col("top").alias("node")).distinct()))
    sizes = tops.groupBy("id", F.col("top").alias("node")).agg(F.count("*").alias("n")).join(whole, ["id", "node"])
    roots = sizes.groupBy("id", "least").agg(F.min(F.struct(-F.col("n"), "node")).alias("best")).select("id", "best.node")
    parents = rerooted(links, checkpointed(roots))
    return nodes.drop("parent").join(parents, ["id", "node"], "left").select(nodes.columns)
