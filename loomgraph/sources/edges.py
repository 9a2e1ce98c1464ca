"""Edges stored once for each end: bucketed and sorted by source, and by target, so that questions from either side move no edge."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lineage import cataloged, write_clustered


class EdgeStore:
    """A folder with two tables of the same edges (source, target, weight and more), ``by_source`` and ``by_target``.

    Joins and sums on a table's own end read its buckets where they are; what is asked for comes to them. A store outlives the session that wrote
    it: ``open`` tells the session's catalog where the buckets lie.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, schema) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.by_source = cataloged(spark, f"{self.path}/by_source", schema, ["source"], buckets)
        self.by_target = cataloged(spark, f"{self.path}/by_target", schema, ["target"], buckets)

    @classmethod
    def save(cls, edges: DataFrame, path: str, buckets: int | None = None) -> EdgeStore:
        """Writes edges, parallel ones summed, into a folder that isn't there yet. Edges without an end or a weight are dropped.

        Give so many buckets that one of them fits a task's memory, and at least as many as joins have shuffle partitions; by default as many as these.
        """
        spark = edges.sparkSession
        n, path = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), path.rstrip("/")
        whole = edges.where("source is not null and target is not null and weight is not null").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
        for end in ("source", "target"):
            write_clustered(whole, [end], f"{path}/by_{end}", n)
        about = spark.createDataFrame([(json.dumps({"buckets": n, "schema": whole.schema.jsonValue()}),)], "about string")
        about.coalesce(1).write.text(f"{path}/about")
        return cls(spark, path, n, whole.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EdgeStore:
        from pyspark.sql.types import StructType

        about = json.loads(spark.read.text(f"{path.rstrip('/')}/about").first()[0])
        return cls(spark, path, about["buckets"], StructType.fromJson(about["schema"]))

    def arcs(self, direction: str = "outputs") -> DataFrame:
        """(near, far, source, target, weight): the edges from the end that a search comes from, read by that end."""
        table, near, far = (self.by_source, "source", "target") if direction == "outputs" else (self.by_target, "target", "source")
        return table.select(F.col(near).alias("near"), F.col(far).alias("far"), "source", "target", "weight")

    def edges_of(self, ids: DataFrame, direction: str = "outputs") -> DataFrame:
        """The edges that leave ids (id), or that arrive at them."""
        end = "source" if direction == "outputs" else "target"
        table = self.by_source if direction == "outputs" else self.by_target
        return table.join(ids.select(F.col("id").alias(end)), end, "left_semi").select("source", "target", "weight")

    def between(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """The edges from one set of ids to another."""
        return self.edges_of(sources).join(targets.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "weight")

    def totals(self) -> DataFrame:
        """(id, n_out, out_weight, n_in, in_weight): each half summed where its buckets are, and the halves joined."""
        out = self.by_source.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"), F.sum("weight").alias("out_weight"))
        into = self.by_target.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"), F.sum("weight").alias("in_weight"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.join(into, "id", "full").select("id", *map(zero, ("n_out", "out_weight", "n_in", "in_weight")))

    def step(self, ids: DataFrame, direction: str = "outputs", labels: DataFrame | None = None) -> DataFrame:
        """(source, target, weight, pairs): one hop from ids (id); with labels (id, label) both ends become their label, and what is labelled alike is summed."""
        found = self.edges_of(ids, direction)
        if labels is not None:
            for end in ("source", "target"):
                named = labels.select(F.col("id").alias(end), F.col("label").alias("_label"))
                found = found.join(named, end, "left").withColumn(end, F.coalesce("_label", F.col(end).cast("string"))).drop("_label")
        return found.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count("*").alias("pairs"))
