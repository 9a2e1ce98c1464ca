"""Joins that never multiply rows, and comparisons of labelled edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.columns import free_name, widened


def first_of_key(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """One row a key: the first in order. Null keys match nothing and are left out."""
    by = W.partitionBy(key).orderBy(*[F.col(c) for c in order])
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", order: tuple[str, ...] = (), suffix: str = "_2") -> DataFrame:
    """Equi-join on one key in which every row of the side that is kept has one row: the other side's first match.

    left, inner and outer keep left rows; right keeps right rows, each with the first left row. One key column stays,
    under the left name. Columns of right whose names are taken get the suffix.
    """
    kind = widened([left.schema[left_key].dataType, right.schema[right_key].dataType]) if how in ("outer", "right") else right.schema[right_key].dataType
    taken = list(left.columns)
    new = {}
    for c in right.columns:
        if c != right_key:
            new[c] = c if c not in taken else free_name(c + suffix if suffix else c, taken)
            taken.append(new[c])
    order = order or tuple(c for c in (left if how == "right" else right).columns)
    if how == "right":
        left = first_of_key(left, left_key, order)
    else:
        right = first_of_key(right, right_key, order) if how != "outer" else first_of_key(right, right_key, order)
    side = right.select(F.col(right_key).cast(kind).alias("_right_key"), *[F.col(c).alias(n) for c, n in new.items()])
    spark_how = {"left": "left", "inner": "inner", "outer": "full_outer", "right": "right"}[how]
    on = left[left_key].cast(kind) == side["_right_key"]
    out = left.join(side, on, spark_how)
    key = F.coalesce(F.col(left_key).cast(kind), F.col("_right_key")) if how in ("outer", "right") else F.col(left_key)
    return out.select(*[key.alias(c) if c == left_key else F.col(c) for c in left.columns], *new.values())


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of annotations on key: right's cells win where they are present."""
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    a, b = left.alias("a"), right.alias("b")

    def cell(c: str):
        sides = [F.col(f"b.{c}")] if c in right.columns else []
        sides += [F.col(f"a.{c}")] if c in left.columns else []
        return F.coalesce(*sides).alias(c)

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*[cell(c) for c in names])


def attach(df: DataFrame, table: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """table's columns by key onto df; a column of the same name is replaced."""
    side = first_of_key(table, key, order)
    kept = [c for c in df.columns if c == key or c not in table.columns]
    return df.select(*kept).join(side, key, "left")


def semi(df: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows of df whose key is among ids; no ids, no rows."""
    return df.join(ids.select(F.col(id_column).alias(key)), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    return df.join(ids.select(F.col(id_column).alias(key)), key, "left_anti")


def compare_connectivity(edges: dict[str, DataFrame], labels: dict[str, DataFrame]) -> DataFrame:
    """pre_label, post_label and for each dataset weight_<name> and present_<name>.

    edges: (pre, post, weight); labels: (id, label), one row an id. Weights are summed by pair of labels. A pair that a dataset does not have
    weighs 0 there where both its labels occur in that dataset, and null where the dataset never sampled one of them.
    """
    sides = []
    for name, e in edges.items():
        by_id = labels[name].where(F.col("label").isNotNull())
        pre, post = by_id.toDF("pre", "pre_label"), by_id.toDF("post", "post_label")
        summed = e.join(pre, "pre").join(post, "post").groupBy("pre_label", "post_label").agg(F.sum("weight").alias(f"weight_{name}"))
        sides.append(summed)
    out = reduce(lambda a, b: a.join(b, ["pre_label", "post_label"], "full_outer"), sides)
    for name in edges:
        pool = labels[name].where(F.col("label").isNotNull()).select("label").distinct()
        for end in ("pre", "post"):
            out = out.join(pool.select(F.col("label").alias(f"{end}_label"), F.lit(True).alias(f"_{end}")), f"{end}_label", "left")
        here = F.coalesce(F.col("_pre") & F.col("_post"), F.lit(False))
        out = out.withColumns({f"present_{name}": here, f"weight_{name}": F.when(here, F.coalesce(f"weight_{name}", F.lit(0)))}).drop("_pre", "_post")
    return out


def synapse_edges(points: DataFrame, polarity: str = "polarity", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts synapse points (neuron, partner, polarity) into edges (pre, post, *by, weight): a post point runs from partner to neuron."""
    flip = F.col(polarity) == "post"
    ends = points.select(F.when(flip, F.col("partner")).otherwise(F.col("neuron")).alias("pre"), F.when(flip, F.col("neuron")).otherwise(F.col("partner")).alias("post"), *by)
    present = ends.where((F.trim(F.col("pre").cast("string")) != "") & (F.trim(F.col("post").cast("string")) != ""))
    return present.groupBy("pre", "post", *by).agg(F.count("*").alias("weight"))


def partner_vectors(edges: DataFrame, queries: DataFrame, labels: DataFrame | None = None, untyped: str = "id", weighting: str = "raw") -> DataFrame:
    """(id, feature, value) for each query id: its partners by direction, ``in:`` and ``out:`` before their label.

    labels: (id, label). Partners without a label stand under their id, or are dropped. weighting fraction divides by
    the id's total of the direction, dropped partners included.
    """
    ids = queries.select(F.col("id")).distinct()
    sides = [("out", "pre", "post"), ("in", "post", "pre")]
    long = reduce(
        lambda a, b: a.unionByName(b),
        [edges.select(F.col(own).alias("id"), F.col(other).alias("partner"), F.lit(d).alias("direction"), "weight") for d, own, other in sides],
    ).join(ids, "id", "left_semi")
    if labels is not None:
        named = labels.select(F.col("id").alias("partner"), F.when(F.trim("label") != "", F.col("label")).alias("label"))
        long = long.join(named, "partner", "left")
    else:
        long = long.withColumn("label", F.col("partner").cast("string"))
    total = F.sum("weight").over(W.partitionBy("id", "direction"))
    long = long.withColumn("total", total) if weighting == "fraction" else long
    if untyped == "drop":
        long = long.where("label is not null")
    feature = F.concat("direction", F.lit(":"), F.coalesce("label", F.col("partner").cast("string")))
    value = F.try_divide(F.col("weight"), F.col("total")) if weighting == "fraction" else F.col("weight")
    return long.select("id", feature.alias("feature"), value.alias("value")).groupBy("id", "feature").agg(F.sum("value").alias("value"))


def update_ids(df: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Repoints stale ids by majority: lookup (old, new) has a row a vote; ties go to the least new id."""
    votes = lookup.groupBy("old", "new").agg(F.count("*").alias("n"))
    best = votes.groupBy("old").agg(F.max_by("new", F.struct("n", -F.col("new"))).alias("_new"))
    out = df.join(best, df[column] == best["old"], "left")
    return out.withColumn(column, F.coalesce("_new", column)).select(df.columns)


def update_ids_by_supervoxel(df: DataFrame, lookup: DataFrame, column: str, supervoxel: str) -> DataFrame:
    """Repoints ids to where each row's own supervoxel is now: lookup (supervoxel, new), a row a supervoxel. Rows without one, or with one that nobody knows, are left alone."""
    nought = F.xxhash64("supervoxel").bitwiseAND(F.lit(0).cast("long"))  # a literal would be no key of the join
    now = lookup.select(F.col("supervoxel").alias("_sv"), F.col("new").alias("_new"), nought.alias("_apart"))
    # Rows without a supervoxel match nothing wherever they are; by null alone they would all come to one task.
    held = df.withColumn("_spread", F.when(F.col(supervoxel).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long")))
    out = held.join(now, (held[supervoxel] == now["_sv"]) & (held["_spread"] == now["_apart"]), "left")
    return out.withColumn(column, F.coalesce("_new", column)).select(df.columns)


#: What a synapse between two compartments is called, and the column that counts it.
CONNECTIONS = {
    "axo-axonic": "weightAxonAxon", "axo-dendritic": "weightAxonDendrite", "dendro-axonic": "weightDendriteAxon", "dendro-dendritic": "weightDendriteDendrite",
    "linker": "weightLinker", "unsplit": "weightUnsplit",
}


def connection_compartments(edges: DataFrame, synapses: DataFrame, pre: str = "preId", post: str = "postId", layout: str = "wide") -> DataFrame:
    """edges with the synapses of each pair counted by the compartment (axon, dendrite, linker or none) at either end.

    synapses: (pre, post, pre_compartment, post_compartment). An end without a compartment makes a synapse unsplit, before a linker end makes it
    one of a linker, so the classes add up to all. wide adds a column a class and synapses, their sum; long has six rows an edge,
    with weight replaced and connection naming the class. Edges that repeat are each counted.
    """
    a, b = F.col("pre_compartment"), F.col("post_compartment")
    names = {("axon", "axon"): "axo-axonic", ("axon", "dendrite"): "axo-dendritic", ("dendrite", "axon"): "dendro-axonic", ("dendrite", "dendrite"): "dendro-dendritic"}
    known = a.isin("axon", "dendrite", "linker") & b.isin("axon", "dendrite", "linker")
    kind = F.when(~F.coalesce(known, F.lit(False)), F.lit("unsplit")).when((a == "linker") | (b == "linker"), F.lit("linker"))
    for (x, y), name in names.items():
        kind = kind.when((a == x) & (b == y), F.lit(name))
    # Pairs without an edge find none below. To look for their edge first would hold every pair once more in the task that counts it.
    counts = synapses.withColumn("_kind", kind).groupBy(F.col("pre").alias("_pre"), F.col("post").alias("_post")).agg(*[F.count(F.when(F.col("_kind") == k, 1)).alias(c) for k, c in CONNECTIONS.items()])
    out = edges.join(counts, (F.col(pre) == F.col("_pre")) & (F.col(post) == F.col("_post")), "left").drop("_pre", "_post")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in CONNECTIONS.values()})
    if layout == "wide":
        return out.withColumn("synapses", reduce(lambda p, q: p + q, [F.col(c) for c in CONNECTIONS.values()]))
    each = F.explode(F.array(*[F.struct(F.col(c).alias("weight"), F.lit(k).alias("connection")) for k, c in CONNECTIONS.items()]))
    kept = [c for c in edges.columns if c not in ("weight", "connection")]
    return out.select(*kept, each.alias("_each")).select(*kept, "_each.weight", "_each.connection")
