"""Skeletons as node tables, from and to SWC files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """(id, node, parent, x, y, z, radius, type): a row a node, id being the file's name without its ending.

    Lines are ``node type x y z radius parent``, set apart by white space. Remarks, lines of fewer fields and lines with a field that is no number are left out, since a made-up
    place would be a stray link. A negative parent, or one that the file doesn't have, makes a root where trees are measured.
    """
    lines = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("id"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    fields = lines.where("line <> '' and not startswith(line, '#')").select("id", F.split("line", " ").alias("f"))
    numbers = fields.where(F.size("f") >= 7).select("id", F.expr("transform(f, x -> try_cast(x AS double))").alias("n"))
    sound = numbers.where(F.forall("n", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n = lambda k: F.col("n")[k]
    parent = F.when(n(6) >= 0, n(6).cast("long"))
    return sound.select("id", n(0).cast("long").alias("node"), parent.alias("parent"), n(2).alias("x"), n(3).alias("y"), n(4).alias("z"), n(5).alias("radius"), n(1).cast("int").alias("type"))


def write_swc(nodes: DataFrame, path: str) -> None:
    """A folder a skeleton, named id=..., with the lines of its nodes in text files; radius and type are 0 where nodes have none."""
    field = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string") if c in nodes.columns else F.lit("0")
    line = F.concat_ws(" ", F.col("node"), field("type"), "x", "y", "z", field("radius"), F.coalesce("parent", F.lit(-1)))
    nodes.select("id", line.alias("line")).repartition("id").sortWithinPartitions("id").write.partitionBy("id").text(path)
