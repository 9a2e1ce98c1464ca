r"""Lines that several documents share, dropped from all but the first of them.

Texts are split at line breaks. A line's key is the line without white space at its ends and with A-Z in lower case; keys are
hashed (128 bits), documents are counted by hash, and of a hash in at least ``least_docs`` documents only the document with the
least id keeps its lines. Only (hash, id, position) are moved to count and to decide; a text is moved once, to meet its positions, and
is put together from the stretches between them.

Lines of one very common hash are summed before they are shuffled; where they meet the verdict on their hash, both sides come straight from stored
tables, so adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import free_name
from loomgraph.llm.common import stored

LEAST_CHARS = 10
LEAST_DOCS = 2


def line_keys(text: str, least_chars: int = LEAST_CHARS) -> tuple[list[int], list[bytes]]:
    """Positions and hashes of the lines whose key has at least least_chars code points."""
    places, hashes = [], []
    for i, line in enumerate(text.encode().lower().split(b"\n")):  # bytes: A-Z alone change, and strip() takes \x20 and \x09-\x0D
        key = line.strip()
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars):
            places.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return places, hashes


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, version, line_at, hash) of docs (id, version, text): a row for each line whose key is long enough."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for text in batch.column("text"):
                at, found = line_keys(text.as_py(), least_chars)
                rows.append(len(at))
                places += at
                hashes += found
            of = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            yield pa.record_batch(
                [batch.column("id").take(of), batch.column("version").take(of), pa.array(places, pa.int32()), pa.array(hashes, pa.binary())],
                names=["id", "version", "line_at", "hash"],
            )

    return docs.mapInArrow(cut, f"id {dict(docs.dtypes)['id']}, version long, line_at int, hash binary")


def without(lines: Column, places: Column) -> Column:
    """The array lines without the elements at places (ascending, from 0), from the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(lines)))
    stretch = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.slice(lines, x["s"] + 1, x["e"] - x["s"]))
    return F.flatten(stretch)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """docs with texts as they stay, and n_lines (before dropping) and n_dropped, under free names.

    A null text stays null and counts as one empty line, as an empty one does. Of a document that loses all its lines the empty text stays. Repeated lines of one
    document count once, and go or stay together. Rows that share an id are one document, each with lines of its own. Rows without an id are no
    document: they make no line common and lose none. Ids may be of any type that has an order. An empty table gives an empty one; other columns are kept.
    """
    taken = list(docs.columns)
    names = {}
    for n in ("n_lines", "n_dropped", "version", "places"):
        names[n] = free_name(n, taken)
        taken.append(names[n])
    version, places = names["version"], names["places"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    lines = stored(hashed_lines(held, least_chars), "lines")
    common = lines.groupBy("hash").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least_docs)
    lost = lines.join(stored(common.select("hash", "first"), "common-lines"), "hash").where("id <> first")
    lost = lost.groupBy("id", "version").agg(F.sort_array(F.collect_set("line_at")).alias(places))
    lost = lost.select(F.col("id").alias(f"{places}_id"), F.col("version").alias(f"{places}_version"), places)
    met = docs.withColumn(version, F.xxhash64(text)).join(lost, (F.col(id_col) == F.col(f"{places}_id")) & (F.col(version) == F.col(f"{places}_version")), "left")
    split = F.split(text, "\n", -1)
    kept = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.array_join(without(split, F.col(places)), "\n"))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    n_dropped = F.coalesce(F.size(places), F.lit(0)).cast("long")
    return met.select(*columns, F.size(split).cast("long").alias(names["n_lines"]), F.when(F.col(places).isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias(names["n_dropped"]))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the texts as they stay."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
