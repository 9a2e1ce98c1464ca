"""Agglomerative trees by merging reciprocal nearest neighbours, and cuts of them.

For single, complete, average and Ward's linkage two clusters that are each other's nearest stay so whatever else is merged, so all such pairs merge in one round,
and the tree is that of merging one pair at a time. A round is two joins of the distances with the clusters they belong to, and one sum. Distances are
one row a pair; no task holds a matrix.

A cluster is named by the least of its observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lineage import checkpointed, forget, measured, running
from loomgraph.operators.network import components
from loomgraph.operators.trees import below, toured

METHODS = ("single", "complete", "average", "ward")


def agglomerated(distances: DataFrame, method: str = "average") -> DataFrame:
    """(step, left, right, height, size, round) of distances (row, col, value): a row a merge, by height; left is the lesser name and that of what is merged.

    All pairs of observations must be given, in either order or both; both agree. Ties merge in the order of names.
    """
    if method not in METHODS:
        raise ValueError(f"no linkage {method}")
    ends = [F.least("row", "col").alias("a"), F.greatest("row", "col").alias("b")]
    half, seen = measured(distances.where("row <> col and value is not null").groupBy(*ends).agg(F.min("value").cast("double").alias("d")), pairs=F.count("*"))
    sizes, told = measured(half.select(F.col("a").alias("c")).union(half.select("b")).distinct().withColumn("n", F.lit(1).cast("long")), n=F.count("*"))
    n = told["n"]
    if seen["pairs"] != n * (n - 1) // 2:
        raise ValueError("linkage needs the distance of every pair")
    found, turn = [], 0
    while n > 1:
        best = F.min(F.struct("d", "a", "b")).alias("best")
        nearest = half.select(F.col("a").alias("c"), "d", "a", "b").union(half.select("b", "d", "a", "b")).groupBy("c").agg(best)
        merged = nearest.groupBy(F.col("best.a").alias("a"), F.col("best.b").alias("b"), F.col("best.d").alias("d")).agg(F.count("*").alias("both")).where("both = 2").drop("both")
        merged = merged.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        merged, told = measured(merged.withColumn("round", F.lit(turn)), n=F.count("*"))
        found.append(merged.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), (F.col("na") + F.col("nb")).alias("size"), "round"))
        # What Ward's sum over pairs counts too much: the spread within a cluster that has just been merged.
        own = F.col("d") * F.col("d") * (F.col("na") + F.col("nb")) / (2 * (F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb")))
        into = merged.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("into"), (F.col("na") + F.col("nb")).alias("m"), own.alias("own"))
        at = sizes.join(into, "c", "left").select("c", "n", F.coalesce("into", "c").alias("into"), F.coalesce("m", "n").alias("m"), F.coalesce("own", F.lit(0.0)).alias("own"))
        at = checkpointed(at)
        pairs = half.join(at.toDF("a", "na", "x", "nx", "ox"), "a").join(at.toDF("b", "nb", "y", "ny", "oy"), "b").where("x <> y")
        share = F.col("na") * F.col("nb")
        if method == "ward":
            apart = F.sum(F.col("d") * F.col("d") * (F.col("na") + F.col("nb")) / 2) / F.first(F.col("nx") * F.col("ny")) - F.first(F.col("ox") + F.col("oy"))
            value = F.sqrt(F.greatest(F.lit(0.0), F.first(2 * F.col("nx") * F.col("ny") / (F.col("nx") + F.col("ny"))) * apart))
        else:
            value = {"single": F.min("d"), "complete": F.max("d"), "average": F.sum(F.col("d") * share) / F.sum(share)}[method]
        pairs = pairs.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")})
        after = checkpointed(pairs.groupBy("lo", "hi").agg(value.alias("d")).toDF("a", "b", "d"))
        forget(half)
        half, sizes, n, turn = after, checkpointed(at.select(F.col("into").alias("c"), F.col("m").alias("n")).distinct()), n - told["n"], turn + 1
    if not found:
        return half.select(F.lit(0).cast("long").alias("step"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("round")).limit(0)
    every = found[0]
    for df in found[1:]:
        every = every.union(df)
    ordered = running(every, [F.col("height"), F.col("round"), F.col("left")], name="step")
    return checkpointed(ordered.select("step", "left", "right", "height", "size", "round"))


def grouped(merges: DataFrame, kept: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster, size): members (id) joined by the kept merges; clusters count from 1, largest first, ties by least id."""
    links = kept.select(F.col("left").alias("source"), F.col("right").alias("target"))
    return components(links, members.select("id").distinct()).select("id", F.col("component").alias("cluster"), "size")


def cut_by_height(merges: DataFrame, members: DataFrame, height: float) -> DataFrame:
    return grouped(merges, merges.where(F.col("height") <= height), members)


def cut_by_count(merges: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """Exactly count clusters, ties or not (as many as there are members at most)."""
    n = members.select("id").distinct().count()
    return grouped(merges, merges.where(F.col("step") < n - max(1, min(count, n))), members)


#: Datasets of a mixed cut: each is a column of counts.
MOST_DATASETS = 50


def cut_mixed(merges: DataFrame, members: DataFrame, most_share: float = 0.8) -> DataFrame:
    """(id, cluster): the deepest clusters that draw from all datasets, none of them with more than most_share of it; members: (id, dataset).

    From the top, a cluster is split if one of its halves is such, kept if itself is, and split otherwise; what is left are clusters of one. Clusters are named
    by their least member.
    """
    names = [r[0] for r in members.select("dataset").distinct().limit(MOST_DATASETS + 1).collect()]
    if len(names) > MOST_DATASETS:
        raise ValueError(f"more than {MOST_DATASETS} datasets")
    # A node a merge and one a member; what takes a cluster up is the next merge that names it.
    made = merges.select((-F.col("step") - 1).alias("node"), F.col("left").alias("name"), F.col("step").alias("since"))
    alone = members.select(F.col("id").alias("node"), F.col("id").alias("name"), F.lit(-1).cast("long").alias("since"))
    used = merges.select(F.explode(F.array("left", "right")).alias("name"), "step", (-F.col("step") - 1).alias("by"))
    events = made.union(alone).select("name", F.col("since").alias("step"), "node", F.lit(None).cast("long").alias("by")).union(used.select("name", "step", F.lit(None).cast("long"), "by"))
    # At one step a merge uses a name first and makes it anew after.
    order = W.partitionBy("name").orderBy("step", F.col("by").isNull())
    up = events.withColumn("parent", F.lead("by").over(order)).where("node is not null")
    zero = F.lit(0.0)
    tour = toured(up.select(F.lit(0).alias("id"), "node", "parent", zero.alias("x"), zero.alias("y"), zero.alias("z")))
    of = tour.select("node", "parent", "place", "size").join(members.select(F.col("id").alias("node"), "dataset"), "node", "left")
    of = checkpointed(of.withColumn("one", F.lit(0)))
    counts = below(of, ["one", "node"], "place", "size", {f"n{k}": F.coalesce((F.col("dataset") == F.lit(name)).cast("long"), F.lit(0)) for k, name in enumerate(names)})
    cells = [F.col(f"n{k}") for k in range(len(names))]
    most, least = (F.greatest(*cells), F.least(*cells)) if len(cells) > 1 else (cells[0], cells[0])
    held = of.join(counts.select("node", ((least > 0) & (most <= sum(cells[1:], cells[0]) * most_share)).alias("mixed")), "node")
    held = checkpointed(held)
    inner = held.where("mixed and parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("_deeper")).distinct()
    kept = checkpointed(held.join(inner, "node", "left").where("mixed and _deeper is null").select("node", "place", "size"))
    # Kept clusters that lie in no other kept one: nothing covers the place where they begin but themselves.
    edges = kept.select(F.col("place").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("turn"), "node").union(kept.select(F.col("place") + F.col("size"), F.lit(0), F.lit(-1), F.lit(None).cast("long")))
    depth = running(edges, [F.col("at"), F.col("kind"), F.col("node")], {"deep": F.col("turn")}, name="_row")
    top = kept.join(depth.where("kind = 1 and deep = 1").select("node"), "node", "left_semi")
    spots = top.select(F.col("place").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("turn"), F.lit(1).alias("new"), F.lit(None).cast("long").alias("member")).union(top.select(F.col("place") + F.col("size"), F.lit(0), F.lit(-1), F.lit(0), F.lit(None).cast("long")))
    spots = spots.union(of.where("dataset is not null").select("place", F.lit(2), F.lit(0), F.lit(0), "node"))
    told = running(spots, [F.col("at"), F.col("kind"), F.col("member")], {"deep": F.col("turn"), "number": F.col("new")}, name="_row").where("member is not null")
    group = F.when(F.col("deep") > 0, F.struct(F.lit(True).alias("in"), F.col("number").alias("k"))).otherwise(F.struct(F.lit(False).alias("in"), F.col("member").alias("k")))
    named = told.select(F.col("member").alias("id"), group.alias("group"))
    return named.join(named.groupBy("group").agg(F.min("id").alias("cluster")), "group").select("id", "cluster")
