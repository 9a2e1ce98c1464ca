"""SimHash near-duplicates found by covering locality-sensitive hashing.

A random map m gives each of the 64 bit positions a non-zero vector of radius + 1 bits. For
every non-zero vector v, one table keys the fingerprints by the bits whose m is not
orthogonal to v. Two fingerprints that differ in at most radius places are equal under some
key: the m of those places span at most radius dimensions, so some v is orthogonal to all of them.
No pair within the radius is missed, whatever the data.

Only distinct fingerprints are keyed, so copies cost nothing. Buckets of any size are compared exactly:
large ones are cut into chunks, and each pair of chunks is a task of its own. A bucket hands on a
star a group and not its pairs, so the rows made stay in proportion to its members.

``near_duplicates`` links by fingerprints of word shingles alone. ``similar_texts`` asks for a similarity of texts: five-word shingles of two
texts that share 0.8 of them differ in ten bits, which no few tables cover. So texts also meet by bands of a min-hash sketch; in a bucket pairs
are told by their sketches, and a spanning forest of the most alike is compared shingle by shingle. Close fingerprints add pairs that the bands leave apart.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import free_name
from loomgraph.llm.common import FILTER_BITS, connected_components, forget, let_go_of_others, likely_among, stored, tidy

SEED = 42
WIDTH = 4
RADIUS = 4
#: Members of one chunk of a large bucket.
CHUNK = 1024
#: Shingles and similarity where texts are compared.
TEXT_WIDTH = 5
SIMILARITY = 0.8
#: Min-hashes of a sketch, of which a byte each is kept, and bands of so many of them that make keys.
SKETCH = 128
BANDS, ROWS = 24, 4
#: Standard deviations of a sketch's estimate by which a pair at the least similarity may fall short of it and is still compared.
DOUBT = 3.5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit SimHash of text's word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: -width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        pairs = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(tidy(compute), f"doc_id {dict(held.dtypes)['doc_id']}, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 8) -> list[int]:
    """2 ** (radius + 1) - 1 masks, as signed longs, of about 32 bits each."""
    vectors = list(range(1, 1 << (radius + 1)))
    draw = random.Random(seed)
    m: list[int] = []
    while len(m) < 64:
        m += draw.sample(vectors, len(vectors))
    m = m[:64]
    masks = []
    for v in vectors:
        mask = sum(1 << i for i in range(64) if (m[i] & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def close_pairs(x: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of members of one group within the radius. side: members of unlike sides meet; side 0 meets all."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(x)]]))
    few = 24
    found_p, found_q = [], []
    small = np.repeat(sizes <= few, sizes)
    for d in range(1, min(int(sizes.max(initial=0)), few)):
        p = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        q = p + d
        near = (np.bitwise_count(x[p] ^ x[q]) <= radius) & ((side[p] == 0) | (side[p] != side[q]))
        found_p.append(p[near])
        found_q.append(q[near])
    for s, n in zip(starts[sizes > few], sizes[sizes > few]):
        for a in range(s, s + n, 256):
            b = min(a + 256, s + n)
            near = np.bitwise_count(x[a:b, None] ^ x[None, a : s + n]) <= radius
            near &= (side[a:b, None] == 0) | (side[a:b, None] != side[None, a : s + n])
            p, q = np.nonzero(near)
            found_p.append((p + a)[p < q])
            found_q.append((q + a)[p < q])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_p or [none]), np.concatenate(found_q or [none])


def stars(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For n members and the links p, q: the first member that each can reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, p, label[q])
        np.minimum.at(label, q, label[p])
        label = label[label]
        if (label == before).all():
            return label


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def star_links(table: pa.Table, group: np.ndarray, radius: int) -> Found:
    """A star for each set of members that links connect."""
    node = table.column("node").to_numpy()
    p, q = close_pairs(table.column("fp").to_numpy().astype(np.int64).view(np.uint64), group, table.column("side").to_numpy(), radius)
    label = stars(p, q, len(node))
    far = np.flatnonzero(node[label] != node)
    return node[label][far], node[far], np.ones(len(far), bool)


def bucket_links(members: DataFrame, radius: int, choose: Callable[[pa.Table, np.ndarray, int], Found]) -> DataFrame:
    """(a, b, whole) among members (bucket columns, side, fp, node), which lie together and in order of their bucket: what choose takes of the links."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table) -> pa.RecordBatch:
            columns = [table.column(c).to_numpy() for c in ("v", "key", "i", "j")]
            change = np.zeros(len(columns[0]), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = np.unique(np.stack(choose(table, np.cumsum(change), radius), axis=1).astype(np.int64), axis=0)
            return pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(edges[:, 2] > 0)], names=["a", "b", "whole"])

        def last_bucket(batch: pa.RecordBatch) -> tuple:
            return tuple(batch.column(c)[-1].as_py() for c in ("v", "key", "i", "j"))

        for batch in batches:
            if not batch.num_rows:
                continue
            last = last_bucket(batch)
            same = np.ones(batch.num_rows, bool)
            for c, value in zip(("v", "key", "i", "j"), last):
                same &= batch.column(c).to_numpy() == value
            cut = batch.num_rows - int(same.sum())
            if cut:
                yield run(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and last_bucket(held[-1]) != last:
                yield run(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield run(pa.Table.from_batches(held))

    return members.mapInArrow(tidy(link), "a long, b long, whole boolean")


def mask_keys(radius: int) -> list[Column]:
    """The key of a fingerprint fp in each covering table."""
    return [F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)]


def bucket_members(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The members of all buckets of keys (v, key, node), a bucket's or pair of chunks' together and in order; nodes (node, fp and more) says what they are.

    Only keys are moved to find buckets of more than one; what a node carries meets the few that are left. Spark takes rows repeated for their keys for as few as
    they were before, so nothing here is left to it to broadcast.
    """
    shared = keys.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(shared.hint("merge"), ["v", "key"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = members.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("node"), chunks).cast("int")})
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    alone = F.col("chunk") == F.col("other")
    members = members.select(
        "v", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.when(alone, 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"), "node",
    ).join(nodes.hint("merge"), "node")
    bucket = ["v", "key", "i", "j"]
    return members.repartition(*bucket).sortWithinPartitions(*bucket, "fp", "node")


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among nodes (node long, fp long) with distinct fp that connect all within the radius."""
    keys = nodes.select("node", F.posexplode(F.array(*mask_keys(radius))).alias("v", "key"))
    return bucket_links(bucket_members(nodes, keys), radius, star_links).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (signed long), component_id: a row for each row of docs.

    component_id is the least doc_id that links of at most radius differing bits reach. Null, empty and blank texts have
    fingerprint zero and are linked like others. Ids are taken to name one text each; rows that repeat are
    linked with each other. A fingerprint that only rows with null ids have links nothing, and those rows have a null component_id. An empty
    table gives an empty one. Other columns are not looked at; ids are integers.
    """
    found = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "nodes")
    links = near_links(nodes.where("node is not null"), radius)
    components = connected_components(links, "components")
    classes = nodes.join(components.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(stored(classes, "classes").hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def blended(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(text: str | None) -> tuple[bytes, np.ndarray]:
    """The words in lower case with one space between, and a hash of each."""
    found = (text or "").encode().translate(_LOWER).split()
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    return b" ".join(found), np.fromiter((known[w] for w in found), np.uint64, len(found))


def hashed_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of the runs of width words; of fewer words, that of all."""
    n = max(len(h) - width + 1, min(len(h), 1))
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = blended(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def multipliers() -> np.ndarray:
    draw = random.Random(SEED)
    return np.array([draw.getrandbits(64) | 1 for _ in range(SKETCH)], np.uint64)[:, None]


_MULTIPLIERS = multipliers()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the shingles under each of SKETCH functions; zeros without shingles."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[None, at : at + 4096] * _MULTIPLIERS).min(axis=1))
    return blended(least) if len(shingles) else np.zeros(SKETCH, np.uint64)


def text_marks(text: str | None, width: int = TEXT_WIDTH) -> tuple[bytes, int, bytes, bytes]:
    """Digest of the words, number of distinct shingles, the sketch's bytes, and the keys of its bands as 8-byte integers."""
    joined, h = hashed_words(text)
    shingles = hashed_shingles(h, width)
    least = sketch(shingles)
    bands = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        bands = blended(bands * np.uint64(0x9E3779B97F4A7C15) + least[k : BANDS * ROWS : ROWS])
    return xxhash.xxh3_128_digest(joined), len(shingles), least.astype(np.uint8).tobytes(), bands.astype("<u8").tobytes()


class Bucket:
    """Members of one bucket: how many values of their sketches agree, where they may be similar."""

    def __init__(self, marks: np.ndarray, size: np.ndarray, side: np.ndarray, low: float, similarity: float) -> None:
        self.marks, self.size, self.side, self.low, self.similarity = marks, size, side, low, similarity

    def row(self, i: int) -> np.ndarray:
        """For each member the number of values in which it agrees with member i; -1 where the two cannot be similar or do not meet here."""
        equal = (self.marks == self.marks[i]).sum(axis=1, dtype=np.int16)
        may = (equal >= self.low) & (np.minimum(self.size, self.size[i]) >= self.similarity * np.maximum(self.size, self.size[i]))
        may &= (self.side[i] == 0) | (self.side != self.side[i])
        may[i] = False
        return np.where(may, equal, -1)

    def forest(self) -> tuple[list[int], list[int]]:
        """The links of a spanning forest whose sketches agree most: from the members placed, the one that agrees most with any of them is placed next."""
        n = len(self.size)
        p, q = [], []
        best, source = np.full(n, -1, np.int16), np.zeros(n, np.int64)
        open_ = np.ones(n, bool)
        while open_.any():
            at = int(np.where(open_, best, -2).argmax())
            if best[at] >= 0:
                p.append(int(source[at]))
                q.append(at)
            open_[at] = False
            row = self.row(at)
            better = open_ & (row > best)
            best[better], source[better] = row[better], at
        return p, q


def least_agreement(similarity: float) -> float:
    """How many values of two sketches agree at least where the texts may be similar."""
    return SKETCH * (similarity - DOUBT * (similarity * (1 - similarity) / SKETCH) ** 0.5)


def sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column("sketch")), np.uint8).reshape(-1, SKETCH)


def sketch_links(table: pa.Table, group: np.ndarray, similarity: float) -> Found:
    """Pairs of members whose sketches leave it open that they are similar: of each bucket a spanning forest of the most alike, which stands for its other pairs."""
    node, size, side = (table.column(c).to_numpy() for c in ("node", "size", "side"))
    marks, low = sketches(table), least_agreement(similarity)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    starts, sizes = bounds[:-1], np.diff(bounds)
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0, bool))]
    # Most buckets hold two: these are compared all at once.
    two = starts[sizes == 2]
    may = (marks[two] == marks[two + 1]).sum(axis=1) >= low
    may &= np.minimum(size[two], size[two + 1]) >= similarity * np.maximum(size[two], size[two + 1])
    may &= (side[two] == 0) | (side[two] != side[two + 1])
    found.append((two[may], two[may] + 1, np.zeros(int(may.sum()), bool)))
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        p, q = Bucket(marks[s : s + n], size[s : s + n], side[s : s + n], low, similarity).forest()
        found.append((np.array(p, np.int64) + s, np.array(q, np.int64) + s, np.ones(len(p), bool)))
    p, q, stands = (np.concatenate(c) for c in zip(*found))
    return np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), stands


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def exact_links(table: pa.Table, group: np.ndarray, similarity: float) -> Found:
    """Links that connect the similar members of each bucket: those of unlike labels are compared shingle by shingle, the most alike sketches first, until what is linked has one label."""
    node, size, side, label = (table.column(c).to_numpy() for c in ("node", "size", "side", "label"))
    marks, low, held, label = sketches(table), least_agreement(similarity), table.column("held"), label.copy()
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    found: list[tuple[int, int]] = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bucket, own = Bucket(marks[s:e], size[s:e], side[s:e], low, similarity), label[s:e]
        sets = [np.frombuffer(held[i].as_buffer(), np.uint64) for i in range(s, e)]
        for i in range(e - s - 1):
            agree = bucket.row(i)
            agree[:i] = -1
            for j in np.argsort(-agree, kind="stable")[: int((agree >= 0).sum())].tolist():
                if own[i] != own[j] and similar(sets[i], sets[j], similarity):
                    own[own == max(own[i], own[j])] = min(own[i], own[j])
                    found.append((s + i, s + j))
    p, q = np.array(found, np.int64).reshape(-1, 2).T
    return np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), np.ones(len(p), bool)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what is made of texts is handed on before more of it is made."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, held) for ids (doc_id): the hashes of the shingles of docs (doc_id, text), stored."""
    texts = likely_among(docs, "doc_id", ids).join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [hashed_shingles(hashed_words(t.as_py())[1], width).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "held"])

    return stored(texts.mapInArrow(tidy(shingles), "doc_id long, held binary"), "shingles")


def similar_pairs(docs: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """pairs (a, b, stands) of doc_ids of docs (doc_id, text), stored, with ``same``: whether their sets of shingles are so similar."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sides = zip(batch.column("x"), batch.column("y"))
            same = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in sides]
            yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("stands"), pa.array(same, pa.bool_())], names=["a", "b", "stands", "same"])

    sets = shingle_sets(docs, ids, width)
    sides = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("held").alias("y")).hint("merge"), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("held").alias("x")).hint("merge"), "a")
    told = stored(sides.select("a", "b", "stands", "x", "y").mapInArrow(tidy(compare), "a long, b long, stands boolean, same boolean"), "told")
    forget(sets)
    return told


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, width: int = TEXT_WIDTH) -> DataFrame:
    """doc_id, component_id: a row for each row of docs.

    Texts of the same words are linked, and those whose sets of width-word shingles have a Jaccard similarity of at least ``similarity``. Such texts meet
    by a band of their sketches or by close fingerprints (within radius bits); a pair at the least similarity is missed with a probability below one in a hundred thousand. Of the
    pairs of a bucket whose sketches leave it open that they are similar, a spanning forest of the most alike is compared. Where one of its links turns out
    dissimilar, all pairs of what failed links lead to that lie apart are compared in tasks of bounded size, which hand on links alone. component_id is the least doc_id that links reach. Null, empty and
    blank texts have the same (no) words. Ids are integers and are taken to name one text each; rows with a null id have no part in links, and a null
    component_id unless others have their words. An empty table gives an empty one. Other columns are not looked at.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_of_others("simhash")
        for batch in sliced(batches):
            texts = [t.as_py() for t in batch.column("text")]
            digests, sizes, sketches, bands = zip(*(text_marks(t, width) for t in texts)) if texts else ((), (), (), ())
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            columns = [pa.array(digests, pa.binary()), pa.array(fps), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array([np.frombuffer(b, "<i8") for b in bands], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "digest", "fp", "size", "sketch", "bands"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(held.mapInArrow(tidy(mark), "doc_id long, digest binary, fp long, size long, sketch binary, bands array<long>"), "marks")
    firsts = found.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = found.join(firsts.hint("merge"), (found["digest"] == firsts["digest"]) & (found["doc_id"] == firsts["node"])).drop(firsts["digest"]).drop("doc_id")
    nodes = stored(nodes.dropDuplicates(["node"]), "texts")
    keys = nodes.where("size > 0").select("node", F.posexplode("bands").alias("v", "key"))
    parts = nodes.select("node", "fp", "size", "sketch")
    chosen = bucket_links(bucket_members(parts, keys), radius, lambda table, group, _: sketch_links(table, group, similarity))
    pairs = stored(chosen.groupBy("a", "b").agg(F.max("whole").alias("stands")), "pairs")
    told = similar_pairs(held, pairs, similarity, width)
    forget(pairs)
    links = told.where("same").select("a", "b")
    at = stored(connected_components(links, "so-far").withColumnRenamed("component", "label"), "so-far")

    def apart(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) in unlike groups so far, with their labels."""
        both = pairs.join(at.toDF("a", "la").hint("merge"), "a", "left").join(at.toDF("b", "lb").hint("merge"), "b", "left")
        return both.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")

    # Close fingerprints: one node stands for those of a fingerprint, and only numbers are moved.
    prints = stored(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("first")), "prints")
    close = near_links(prints.select(F.col("first").alias("node"), "fp"), radius)
    equal = nodes.where("size > 0").select("node", "fp").join(prints.hint("merge"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    close = stored(apart(close.union(equal)).select("a", "b", F.lit(False).alias("stands")).distinct(), "close")
    if not close.isEmpty():
        links = links.union(similar_pairs(held, close, similarity, width).where("same").select("a", "b"))
    # Where a forest breaks, a pair that it stood for may link what it leaves apart: such pairs lie in groups that failed links lead to from each other.
    failed = apart(told.where("stands and not same").select("a", "b")).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    failed = stored(failed.distinct(), "failed")
    if not failed.isEmpty():
        clusters = stored(connected_components(failed, "clusters").toDF("label", "cluster"), "clusters")
        labelled = parts.join(at.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")).join(clusters.hint("merge"), "label")
        labelled = stored(labelled, "labelled")
        sets = shingle_sets(held, labelled.select(F.col("node").alias("doc_id")), width).withColumnRenamed("doc_id", "node")
        keys = labelled.select("node", F.lit(0).alias("v"), F.col("cluster").alias("key"))
        members = bucket_members(labelled.drop("cluster").join(sets.hint("merge"), "node"), keys)
        more = bucket_links(members, radius, lambda table, group, _: exact_links(table, group, similarity))
        links = links.union(stored(more.select("a", "b"), "more"))
    components = connected_components(links, "components")
    classes = firsts.join(components.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return found.select("doc_id", "digest").join(stored(classes, "classes").hint("merge"), "digest", "left").select("doc_id", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, width: int = TEXT_WIDTH) -> DataFrame:
    """The rows of docs that stand for their group of similar texts: the least doc_id's, one of its repeated rows.

    Rows with null ids stay. All columns are kept, whatever they are called. A bit filter of fixed size lets most rows that stay pass where they are; only
    those that it cannot tell are joined with the ids in question. However full it is, the result is the same.
    """
    columns, names, taken = [F.col(c) for c in docs.columns], [], list(docs.columns)
    for n in ("asked_bit", "asked_word", "asked_bits", "asked_id"):
        names.append(free_name(n, taken))
        taken.append(names[-1])
    bit, word, bits, asked_id = names
    found = similar_texts(docs, id_col, text_col, similarity, radius, width)
    # Ids that go, and ids whose rows must be counted: all others stay without being moved.
    asked = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.expr("max(cast(doc_id <> component_id AS int))").alias("goes"))
    asked = stored(asked.where("n > 1 or goes = 1"), "asked")
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))
    words = asked.select(place("doc_id").alias("at")).groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias(bits))
    # At most FILTER_BITS / 64 rows, whatever the corpus.
    held = docs.withColumn(bit, place(id_col)).join(F.broadcast(words), F.shiftright(bit, 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftright({bits}, cast({bit} % 64 as int)) & 1L") == 1, F.lit(False))
    free = held.where(~hit).select(*columns)
    suspects = held.where(hit).select(*columns)
    kept = suspects.join(asked.select(F.col("doc_id").alias(asked_id)).hint("merge"), F.col(id_col) == F.col(asked_id), "left_anti")
    once = asked.where("goes = 0").select(F.col("doc_id").alias(asked_id))
    if not once.isEmpty():
        kept = kept.union(suspects.join(once.hint("merge"), F.col(id_col) == F.col(asked_id), "left_semi").dropDuplicates([id_col]))
    return free.union(kept)
