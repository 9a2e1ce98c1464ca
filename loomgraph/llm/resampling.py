r"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target than in the corpus.

Features are the runs of 1 to 3 consecutive words, hashed into buckets. Texts share most of their lines, so features are counted by segment: line breaks
separate words, so they cut a text into lines; each distinct line of the corpus is cut into words and hashed once, and its counts are
multiplied by how often the line occurs. Runs that cross a line break belong to the text alone and are added separately; of a text no more than
the two words on either side of its lines take part in those.

The hash is a CRC-32. It is linear, so that of a run follows from those of its parts by table look-ups over whole batches: the crc of
a before b is the crc of a pushed through len(b) zero bytes, xor the crc of b.

The drawn documents are the highest scores: log weight plus Gumbel noise from the document's id, which is sampling without
replacement. They are ranked over ranges of one order, so no task and no driver holds them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lineage import running
from loomgraph.llm.common import forget, stored

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
#: Bytes of text that are hashed at once.
_SLICE = 1 << 22
#: What is no word's byte becomes a space, A-Z become a-z; line breaks stay in the second table.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_NEAR = 64


def pushed_byte() -> np.ndarray:
    """The table of CRC-32 for one byte, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


@cache
def pushed() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables by which a crc passes n zero bytes: for n below _NEAR, and for _NEAR times each power of two below 2 ** 26."""
    one = pushed_byte()
    unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    near = [unit]
    for _ in range(_NEAR):
        near.append(one[near[-1] & 0xFF] ^ (near[-1] >> 8))
    far = [near[_NEAR]]
    for _ in range(25):
        far.append(through(far[-1], far[-1]))
    return np.stack(near[:_NEAR]), far


def through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


def after_zeros(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The crcs c after n zero bytes each."""
    near, far = pushed()
    low = n % _NEAR
    out = near[low, 0, c & 0xFF] ^ near[low, 1, (c >> 8) & 0xFF] ^ near[low, 2, (c >> 16) & 0xFF] ^ near[low, 3, c >> 24]
    high = n // _NEAR
    for k in range(int(high.max(initial=0)).bit_length()):
        at = np.flatnonzero(high >> k & 1)
        out[at] = through(far[k], out[at])
    return out


class Crcs:
    """Crcs of words and of their runs. Words seen before are looked up, at most MOST of them."""

    MOST = 500_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 3), np.int64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """(n, 3): the crc of each word, that of a space and the word, and the length of the two."""
        if len(self.known) > self.MOST:
            self.__init__()
        known, new = self.known, []
        for w in set(words):
            if w not in known:
                known[w] = len(known)
                new.append((zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1))
        if new:
            self.table = np.concatenate([self.table, np.array(new, np.int64)])
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def runs(self, words: list[bytes]) -> list[np.ndarray]:
        """For k = 1, 2, ...: the crcs of the runs of k words, by first word."""
        found = self.of(words)
        spaced, length = found[:, 1].astype(np.uint32), found[:, 2]
        out = [found[:, 0].astype(np.uint32)]
        for k in range(1, min(LONGEST, len(words))):
            out.append(after_zeros(out[-1][: len(words) - k], length[k:]) ^ spaced[k:])
        return out


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts in UTF-8; null: empty) in slices of some megabytes."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode()
        held.append(b)
        size += len(b)
        if size >= _SLICE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def segment_features(lines: list[bytes], crcs: Crcs, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of features of each line, and the buckets of all features, line by line."""
    cut = [b.translate(_WORDS).split() for b in lines]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    words = [w for ws in cut for w in ws]
    of = np.repeat(np.arange(len(cut)), n)
    sizes = np.zeros(len(cut), np.int64) + sum(np.maximum(n - k, 0) for k in range(LONGEST))
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint16)
    for k, crc in enumerate(crcs.runs(words)):
        inside = of[: len(words) - k] == of[k:]
        line = of[: len(words) - k][inside]
        counts = np.bincount(line, minlength=len(cut))
        rank = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[start[line] + rank] = crc[inside] % buckets
        start = start + counts
    return sizes, out


def edge_words(text: bytes) -> tuple[int, list[bytes], list[int]]:
    """Number of words of text, and those that a run across a line break may have, each with its line.

    Of a long line only the words at its ends are given. No run crosses a break and has words from both sides of what is left out.
    """
    n, words, of, near = 0, [], [], LONGEST - 1
    for i, line in enumerate(text.split(b"\n")):
        ws = line.translate(_WORDS).split()
        n += len(ws)
        if len(ws) > 2 * near:
            ws = ws[:near] + ws[-near:]
        words += ws
        of += [i] * len(ws)
    return n, words, of


def crossing_features(texts: list[bytes], crcs: Crcs, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and the buckets of its runs that cross a line break."""
    found = [edge_words(b) for b in texts]
    words = [w for f in found for w in f[1]]
    line = np.array([i for f in found for i in f[2]], np.int64)
    of = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
    held, owner = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for k, crc in enumerate(crcs.runs(words)):
        crosses = (of[: len(words) - k] == of[k:]) & (line[: len(words) - k] != line[k:])
        held.append((crc[crosses] % buckets).astype(np.uint16))
        owner.append(of[: len(words) - k][crosses])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(1, len(found)))
    return np.array([f[0] for f in found], np.int64), np.split(np.concatenate(held)[order], bounds)


def cut_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, id, n_words, held, lines) of docs (row, id, text): the buckets of runs across line breaks, and a hash of each line that has words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs = Crcs()
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                n, found = crossing_features(texts, crcs, buckets)
                hashes = [[xxhash.xxh3_128_digest(b) for b in t.split(b"\n") if not b.translate(_WORDS).isspace() and b] for t in texts]
                whole = [batch.column(c).slice(first, len(texts)) for c in ("row", "id")]
                held = pa.array([f.astype("<u2").tobytes() for f in found], pa.binary())
                yield pa.record_batch([*whole, pa.array(n), held, pa.array(hashes, pa.list_(pa.binary()))], names=["row", "id", "n_words", "held", "lines"])

    return docs.select("row", "id", "text").mapInArrow(cut, f"row long, id {dict(docs.dtypes)['id']}, n_words long, held binary, lines array<binary>")


def line_features(lines: DataFrame, buckets: int) -> DataFrame:
    """(line, n, held) of distinct lines (text, n) that have words: the line's hash and the buckets of its runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs = Crcs()
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                sizes, found = segment_features(texts, crcs, buckets)
                raw, ends = found.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                some = np.flatnonzero(sizes)
                columns = [[xxhash.xxh3_128_digest(texts[i]) for i in some], batch.column("n").take(pa.array(some + first)), [raw[2 * ends[i] : 2 * ends[i + 1]] for i in some]]
                yield pa.record_batch([pa.array(columns[0], pa.binary()), columns[1], pa.array(columns[2], pa.binary())], names=["line", "n", "held"])

    return lines.select("text", "n").mapInArrow(count, "line binary, n long, held binary")


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(text, n): the lines of texts (text), each once, and how often it occurs; counted before they are moved."""
    return texts.select(F.explode(F.split("text", "\n", -1)).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def shorts(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All unsigned shorts of the rows, and how many each row has."""
    raw = [x.as_py() for x in held]
    return np.frombuffer(b"".join(raw), "<u2"), np.fromiter(map(len, raw), np.int64, len(raw)) // 2


def bucket_totals(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s) of held (held, n): how often each bucket occurs, a row counted n times. A task hands on at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found, sizes = shorts(batch.column("held"))
            np.add.at(total, found, np.repeat(batch.column("n").to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "s"])

    return held.select("held", F.col("n").cast("long").alias("n")).mapInArrow(count, "bucket int, s long")


def totals(cut: DataFrame, lines: DataFrame, buckets: int) -> list[int]:
    """The number of features in each bucket: those of lines times their occurrences, and those across lines. One row a bucket comes to the driver."""
    parts = bucket_totals(lines.select("held", "n"), buckets).union(bucket_totals(cut.select("held", F.lit(1).alias("n")), buckets))
    out = [0] * buckets
    for bucket, s in parts.groupBy("bucket").agg(F.sum("s")).collect():
        out[bucket] = s
    return out


def gains(s: list[int], t: list[int]) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of how much likelier it is in the target, both smoothed by one."""
    n, all_s, all_t = len(s), sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + n) / ((a + 1) * (all_t + n)))) for a, b in zip(s, t)], np.int64)


def gained(df: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """keep and weight: the sum of gains over the buckets in df.held. The gains are one number a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = shorts(batch.column("held"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(upto[ends[1:]] - upto[ends[:-1]])], names=[*keep, "weight"])

    kinds = dict(df.dtypes)
    return df.select(*keep, "held").mapInArrow(add, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", weight long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(row, id, n_words, weight), stored: a row for each row of docs; weight sums the gains of its features, 0 without any."""
    # Rows are numbered in the very step that stores them, so the numbers stay.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = stored(cut_texts(rows, buckets), "segments")
    lines = stored(line_features(distinct_lines(rows.select("text")), buckets), "line-features")
    wanted = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("id"), F.coalesce(F.col(target_text_col), F.lit("")).alias("text"))
    gain = gains(totals(cut, lines, buckets), totals(cut_texts(wanted, buckets), line_features(distinct_lines(wanted.select("text")), buckets), buckets))
    by_line = stored(gained(lines, ["line"], gain), "line-weights")
    kind = dict(cut.dtypes)["id"]
    across = gained(cut, ["row", "id", "n_words"], gain)
    inside = cut.select("row", F.explode("lines").alias("line")).join(by_line, "line").select("row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("n_words"), "weight")
    whole = across.union(inside).groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))
    out = stored(whole, "weights")
    forget(cut, lines, by_line)
    return out


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_sample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs.

    Of the N rows with an id and at least least_words words, the floor(percent * N / 100) of the highest score have rank 1, 2, 3, ...; ties go to
    the lesser id. Null texts have no words, weight 0. Rows that share an id are told apart, and have the same noise. Rows without an id have neither score nor rank. An
    empty target leaves its counts at zero; an empty docs gives an empty table. Other columns are not looked at. buckets is at most 65,536.
    """
    held = weights(docs, target, id_col, text_col, target_text_col, buckets)
    features = sum(F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(LONGEST))
    held = held.select("id", "n_words", features.cast("long").alias("n_features"), "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    may = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    drawn = percent * held.where(may).count() // 100
    ranked = running(held.where(may), [F.col("score").desc(), F.col("id")], name="row_at")
    ranked = ranked.withColumn("rank", F.when(F.col("row_at") < drawn, F.col("row_at") + 1)).drop("row_at")
    every = ranked.union(held.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
