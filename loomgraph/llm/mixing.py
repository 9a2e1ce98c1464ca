"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the mix in proportion to its weight. No source can give
more than ``max_epochs`` times its own size, so those that would are clamped there and what they
cannot give goes to the others in proportion to their weights, again and again until no
target lies above its clamp. A source is then repeated as a whole as often as its target holds it,
and the fraction that remains is sampled: its documents are put in the order of a seeded
hash and taken from the front until the fraction's words are reached; the last of them gives its
first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, in_order, part_starts, stored

#: Documents of a source are first summed in so many ranges of their hash.
DRAW_BITS, BUCKET_BITS = 60, 12
#: So many sources at most are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(identity: list[Column], seed: int) -> Column:
    """The first DRAW_BITS bits of an MD5 digest, which SQL engines share."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in identity]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def water_filling(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """sources (source, source_size, weight) with ``target``.

    The targets are min(max_epochs * source_size, level * weight). The level rises from round to
    round as more sources are clamped; only sums reach the driver.
    """
    most = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        over = (F.lit(level) * F.col("weight") > most) | (F.col("weight") <= 0)
        fixed, free = sources.agg(
            F.sum(F.when(over, F.when(F.col("weight") > 0, most).otherwise(0.0))),
            F.sum(F.when(~over, F.col("weight").cast("double"))),
        ).first()
        if not free:
            break
        risen = (total - (fixed or 0.0)) / free
        if risen <= level:
            break
        level = risen
    target = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(most, F.lit(max(level, 0.0)) * F.col("weight")))
    return sources.withColumn("target", target)


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Gives sources their weights in turn, in order of their code points, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = in_order(sources, order, "sources")
    ranked = ranked.join(F.broadcast(part_starts(ranked, "part", F.lit(1))), "part")
    turn = (F.col("part_start") + F.col("part_row")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return ranked.select("source", "source_size", weight.alias("weight"))


def joined_to_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Left join on the null-safe source. Beyond the bound the hot source is split by adaptive execution."""
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    side = side.withColumnRenamed("source", "of_source")
    return rows.join(side, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: float = 3.0,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): a row a document with its size and draw, and a row a source with what it gives.

    plan: source, source_size, target, whole, cut, cut_words. A document gives whole times its words, once
    more if draw < cut, and cut_words more if draw = cut.

    Null and empty texts have size 0 and take nothing. A null source is a source of its own, the last one.
    Repeated rows draw the same number; where the cut falls on them they give equal parts. An empty
    table gives two empty ones. Other columns are not looked at.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        seeded_hash([F.col(id_col), F.col(text_col)], seed).alias("draw"),
    )
    sized = stored(sized, "sizes")
    bucket = F.shiftright("draw", DRAW_BITS - BUCKET_BITS)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sums = stored(sums, "bucket-sums")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = stored(water_filling(cycled_weights(sources, weights), max_epochs), "targets")
    n_sources = plan.count()
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", times)
    plan = plan.withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def at_cut(rows: DataFrame, by: str) -> DataFrame:
        """The first row of each source at which the running sum reaches left."""
        w = W.partitionBy("source").orderBy(by)
        rows = rows.withColumn("upto", F.sum("words").over(w))
        return rows.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")) & (F.col("words") > 0))

    wanted = plan.select("source", F.col("part").alias("left"))
    cut = at_cut(joined_to_sources(sums, wanted, n_sources), "bucket")
    cut = cut.select("source", F.col("bucket").alias("cut_bucket"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"))
    inside = joined_to_sources(sized, cut, n_sources).where(bucket == F.col("cut_bucket"))
    inside = inside.groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("tied"), F.first("left").alias("left"))
    cut = at_cut(inside, "draw")
    cut = cut.select("source", F.col("draw").alias("cut"), F.floor((F.col("left") - F.col("upto") + F.col("words")) / F.col("tied")).alias("cut_words"))
    plan = joined_to_sources(plan, cut, n_sources)
    everything = F.col("part") >= F.col("source_size")  # rounding can ask for one whole time more
    plan = plan.select(
        "source", "source_size", "target", (F.col("whole") + F.when(everything & (F.col("source_size") > 0), 1).otherwise(0)).alias("whole"),
        F.when(~everything, F.col("cut")).alias("cut"), "cut_words",
    )
    return sized, stored(plan, "mixture")


def extra_words() -> Column:
    return (
        F.when(F.col("draw") < F.col("cut"), F.col("size"))
        .when(F.col("draw") == F.col("cut"), F.least("cut_words", "size"))
        .otherwise(0)
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: a row for each row of docs."""
    sized, plan = mixture(docs, **options)
    rows = joined_to_sources(sized, plan, plan.count())
    taken = F.col("size") * F.col("whole") + extra_words()
    return rows.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, **options
) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, the cut one with its first words only.

    Columns are those of docs; rows that the mix does not take are gone, and a null or empty
    text, which gives no words either way, stays once as it is.
    """
    _, plan = mixture(docs, id_col, source_col, text_col, seed=seed, **options)
    columns = [F.col(c) for c in docs.columns]
    held = docs.select(
        F.struct(*columns).alias("row"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        seeded_hash([F.col(id_col), F.col(text_col)], seed).alias("draw"),
    )
    held = joined_to_sources(held, plan, plan.count())
    extra = extra_words()
    held = held.withColumns({"copies": F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + (extra == F.col("size")).cast("long")), "first": F.when((extra > 0) & (extra < F.col("size")), extra)})
    counts = F.concat(
        F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int")),
        F.when(F.col("first").isNotNull(), F.array(F.col("first").cast("long"))).otherwise(F.array().cast("array<long>")),
    )
    rows = held.select("row", F.explode(counts).alias("first"))
    text = F.when(F.col("first").isNull(), F.col("row")[text_col]).otherwise(first_words(F.col("row")[text_col], F.col("first")))
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(n, F.lit(1)).cast("int")), " ")
