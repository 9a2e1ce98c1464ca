"""Points in closed surfaces, by the parity of a ray.

A ray runs along x from each point. Triangles lie in cells over (y, z) whose size follows their own, so each is in at most four; a point looks into one
cell a size that occurs. What meets in a cell is tested by plain expressions, and crossings are counted by point and volume: no task holds a mesh.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import free_name
from loomgraph.functions.lineage import checkpointed, running


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(roi, face, ax .. cz) of OBJ files: a row a triangle, roi being the file's name without its ending.

    Vertices are numbered by the lines before them, over ranges of all lines, so a file may be as large as it likes. Indices from the end (-1: the
    vertex last given) and slashes are understood; faces of more corners become fans. Other lines, and faces whose vertices are missing, are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("f"))
    lines = lines.where(F.col("f")[0].isin("v", "f") & (F.size("f") >= 4))
    kind = F.col("f")[0]
    numbered = running(lines, [F.col("file"), F.col("block"), F.col("line")], {"v": (kind == "v").cast("long")}, name="at")
    numbered = checkpointed(numbered.select("file", "at", "f", "v"))
    base = numbered.groupBy("file").agg(F.min(F.col("v") - (kind == "v").cast("long")).alias("base"))
    numbered = numbered.join(base, "file").withColumn("v", F.col("v") - F.col("base"))
    vertices = numbered.where(kind == "v").select("file", "v", *[F.expr(f"try_cast(f[{k + 1}] AS double)").alias(c) for k, c in enumerate("xyz")])
    index = F.transform(F.slice("f", 2, 1_000_000), lambda t: F.regexp_extract(t, r"^(-?\d+)", 1).cast("long"))
    faces = numbered.where(kind == "f").select("file", "at", F.transform(index, lambda i: F.when(i < 0, F.col("v") + 1 + i).otherwise(i)).alias("i"))
    fan = faces.select("file", "at", "i", F.explode(F.sequence(F.lit(2), F.size("i") - 1)).alias("k"))
    fan = fan.select("file", "at", "k", F.col("i")[0].alias("a"), F.element_at("i", F.col("k")).alias("b"), F.element_at("i", F.col("k") + 1).alias("c"))
    for corner in "abc":
        fan = fan.join(vertices.toDF("file", corner, *[f"{corner}{c}" for c in "xyz"]), ["file", corner])
    cells = [f"{corner}{c}" for corner in "abc" for c in "xyz"]
    return fan.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("roi"), F.struct("at", "k").alias("face"), *cells)


def crosses(y: Column, z: Column, p: str, q: str) -> Column:
    """Whether the ray to the left of (y, z) in its plane passes between corners p and q: told alike for both triangles that share the two."""
    up = F.col(f"{p}z") <= F.col(f"{q}z")
    lo = lambda c: F.when(up, F.col(f"{p}{c}")).otherwise(F.col(f"{q}{c}"))
    hi = lambda c: F.when(up, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}"))
    return (lo("z") <= z) & (z < hi("z")) & (y < lo("y") + (hi("y") - lo("y")) * (z - lo("z")) / (hi("z") - lo("z")))


def in_meshes(points: DataFrame, triangles: DataFrame, order: list[str] | None = None, column: str = "roi") -> DataFrame:
    """points with the column roi: the volume of triangles (roi, ax .. cz) that holds a point, null outside all.

    Where volumes overlap the first in order has the point, or the first by name. A column of that name is overwritten. Surfaces must be closed; a point on one may be either in or out. Points without
    a place are outside.
    """
    taken = [c for c in points.columns if c != column]
    row = free_name("_row", taken)
    # Rows are numbered in what is written, so the numbers stay.
    held = checkpointed(points.select(*taken).withColumn(row, F.monotonically_increasing_id()))
    corners = lambda c: [F.col(f"{k}{c}") for k in "abc"]
    wide = F.greatest(F.greatest(*corners("y")) - F.least(*corners("y")), F.greatest(*corners("z")) - F.least(*corners("z")))
    # The size of a triangle's cells is the power of two above its own; flat ones have no cell, since no ray crosses them.
    sized = triangles.withColumn("level", F.ceil(F.log2(wide)).cast("int")).where(wide > 0)
    span = lambda c, f: F.floor(f(*corners(c)) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    cells = sized.withColumn("gy", F.explode(F.sequence(span("y", F.least), span("y", F.greatest)))).withColumn("gz", F.explode(F.sequence(span("z", F.least), span("z", F.greatest))))
    levels = [r[0] for r in sized.select("level").distinct().collect()]  # at most the powers of two that doubles have
    if not levels:
        return held.select(*taken, F.lit(None).cast("string").alias(column))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    looks = held.select(row, "x", "y", "z", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])).alias("level")).where("x is not null and y is not null and z is not null")
    looks = looks.withColumns({"gy": at("y"), "gz": at("z")})
    met = looks.join(cells, ["level", "gy", "gz"])
    y, z = F.col("y"), F.col("z")
    inside = (crosses(y, z, "a", "b").cast("int") + crosses(y, z, "b", "c").cast("int") + crosses(y, z, "c", "a").cast("int")) % 2 == 1
    u = lambda c: F.col(f"b{c}") - F.col(f"a{c}")
    v = lambda c: F.col(f"c{c}") - F.col(f"a{c}")
    nx, ny, nz = u("y") * v("z") - u("z") * v("y"), u("z") * v("x") - u("x") * v("z"), u("x") * v("y") - u("y") * v("x")
    ahead = F.col("ax") - (ny * (y - F.col("ay")) + nz * (z - F.col("az"))) / nx > F.col("x")
    hits = met.where(inside & (nx != 0)).where(ahead).groupBy(row, "roi").agg(F.count("*").alias("n")).where("n % 2 = 1")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in order]), F.col("roi")), F.lit(0)) if order else F.lit(0)
    first = hits.groupBy(row).agg(F.min(F.struct(rank.alias("k"), F.col("roi").alias("roi"))).alias("best")).select(row, F.col("best.roi").alias("_found"))
    return held.join(first, row, "left").select(*taken, F.col("_found").alias(column))
