"""A dataset handle: neurons, edges and synapses of one backend, and the questions that a backend answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.predicates import all_rows


@dataclass
class Dataset:
    """neurons (id, ...), edges (pre, post, weight [, region]), synapses (pre, post, x, y, z, ...). All lazy.

    Population filters are ORed with each other and hold for every question.
    """

    name: str
    neurons: DataFrame
    edges: DataFrame
    synapses: DataFrame | None = None
    population: list[Column] = field(default_factory=list)

    @classmethod
    def at(cls, spark: SparkSession, name: str, folder: str, version: str | None = None) -> Dataset:
        """Parquet tables neurons, edges and synapses under folder, or under one of its versions."""
        base = f"{folder}/{version}" if version else folder
        return cls(name, *[spark.read.parquet(f"{base}/{t}.parquet") for t in ("neurons", "edges", "synapses")])

    def register(self) -> None:
        """Makes the tables views, for ``query``."""
        for kind in ("neurons", "edges", "synapses"):
            df = getattr(self, kind)
            if df is not None:
                df.createOrReplaceTempView(f"{self.name}_{kind}")

    def query(self, sql: str) -> DataFrame:
        self.register()
        return self.neurons.sparkSession.sql(sql)

    def members(self) -> DataFrame:
        if not self.population:
            return self.neurons
        held = self.population[0]
        for p in self.population[1:]:
            held = held | p
        return self.neurons.where(F.coalesce(held, F.lit(False)))

    def find(self, rows: list[dict], limit: int | None = None) -> DataFrame:
        out = self.members().where(all_rows(self.neurons, rows))
        return out.orderBy("id").limit(limit) if limit else out

    def connections(self, ids: DataFrame, direction: str = "outputs") -> DataFrame:
        own = "pre" if direction == "outputs" else "post"
        return self.edges.join(ids.select(F.col("id").alias(own)), own, "left_semi")

    def between(self, sources: DataFrame | None, targets: DataFrame | None) -> DataFrame:
        """Synapses from any of sources onto any of targets; a side that is missing is everyone."""
        out = self.synapses
        if sources is not None:
            out = out.join(sources.select(F.col("id").alias("pre")), "pre", "left_semi")
        if targets is not None:
            out = out.join(targets.select(F.col("id").alias("post")), "post", "left_semi")
        return out

    def totals(self, by: str = "post") -> DataFrame:
        return self.edges.groupBy(F.col(by).alias("id")).agg(F.sum("weight").alias("total"))

    def region_counts(self) -> DataFrame:
        """(id, region, pre, post): synapses that leave and reach each neuron in each region, in one aggregation over both ends."""
        ends = F.array(F.struct(F.col("pre").alias("id"), F.col("weight").alias("pre"), F.lit(0).cast("long").alias("post")), F.struct(F.col("post").alias("id"), F.lit(0).cast("long").alias("pre"), F.col("weight").alias("post")))
        long = self.edges.select("region", F.explode(ends).alias("e")).select("e.id", "region", F.col("e.pre").alias("o"), F.col("e.post").alias("i"))
        return long.groupBy("id", "region").agg(F.sum("o").alias("pre"), F.sum("i").alias("post"))

    def synapses_of(self, ids: DataFrame, polarity: str | None = None, region: str | None = None, least: float = 0.0, confidence: str = "confidence") -> DataFrame:
        """The synapses of neurons (id) as points: neuron, partner, polarity and the synapse's other columns, a row a neuron's end.

        polarity pre keeps outputs, post inputs. A synapse between two of ids is one point of each.
        """
        held = self.synapses
        if region is not None:
            held = held.where(F.col("region") == region)
        if least > 0:
            held = held.where(F.col(confidence) >= least)
        sides = []
        for name, own, other in (("pre", "pre", "post"), ("post", "post", "pre")):
            if polarity in (None, name):
                one = held.join(ids.select(F.col("id").alias(own)).distinct(), own, "left_semi")
                rest = [c for c in self.synapses.columns if c not in ("pre", "post")]
                sides.append(one.select(F.col(own).alias("neuron"), F.col(other).alias("partner"), F.lit(name).alias("polarity"), *rest))
        return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
