"""Token ids as compact binary output under one canonical, length-limited Huffman code.

Written table: a row a document, (shard, doc_id, n_tokens, checkpoints, payload). The payload is
the document's ids in code words of at most MAX_BITS bits. Every BLOCK ids a new block begins,
whose first bit ``checkpoints`` names, so blocks decode independently: the decoder runs through all blocks of
many documents side by side, each step one look-up in a table over the next MAX_BITS bits. Shards are
ranges of doc_id, and rows ascend by doc_id within a shard. The code is a table of its own, one row an
id: (id, bits); canonical code words follow from the lengths.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import give_back, keeps, let_go_of_others, new_path, part_starts, stored, tidy

#: Longest code word; the decoder's table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Ids between two checkpoints.
BLOCK = 512
#: Code words of so many ids go to one shard, at the most that cut points can tell.
SHARD_IDS = 32_000_000
#: Ids held for one step of the decoder; longer documents are held alone.
BATCH_IDS = 1_000_000
#: Words whose ids a worker keeps: half in use, half of the generation before.
CACHED_WORDS = 1_000_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4 << 20
#: Marks that stand alone after letters.
ENDS = frozenset(".,;:!?")
#: Words that the library encodes in one call.
WORDS_AT_ONCE = 8192


class Encoder:
    """A tokenizers file as a function from a column of texts to one array of ids and the end of each text in it.

    Where the tokenizer drops white space and splits at it (word_bpe_49k does), a text's ids are those of its words one after
    another, so each distinct word of a slice is looked up once. Words that two generations of looked-up words lack are encoded
    together, in one library call.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        config = json.loads(self.tokenizer.to_str())
        self.by_word = self.drops_white_space(config)
        self.added = tuple(t["content"] for t in config.get("added_tokens", []))
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16 or (end_id or 0) >> 16 > 0
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.end = [] if end_id is None else [end_id]
        if self.by_word:
            import regex

            steps = config["pre_tokenizer"]["pretokenizers"]
            self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
            # The same merges over pieces that are cut and spelt already; a piece's last id is one that ends a word.
            self.merges = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            suffix = config["model"]["end_of_word_suffix"]
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.closes[i] = token.endswith(suffix)
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @staticmethod
    def drops_white_space(config: dict) -> bool:
        kinds = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and config["model"]["type"] == "BPE"
            and bool(config["model"].get("end_of_word_suffix"))
        )

    def spelt(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        out: list[bytes] = [b""] * len(words)
        joined = b"\n".join(words).decode()
        special = [t for t in self.added if t in joined]
        pieces: list[str] = []
        upto, plain, others = [0], [], []
        for i, (word, lower) in enumerate(zip(joined.split("\n"), joined.lower().split("\n"))):
            # Beyond Latin letters, case rules differ between languages' libraries; the tokenizer itself decides there.
            if (not word.isascii() and (max(word) > "ɏ" or "İ" in word)) or (special and any(t in word for t in special)):
                others.append(i)
                continue
            mark = lower[-1:] if lower[-1:] in ENDS else ""
            if (lone := lower[:-1] if mark else lower).isalpha():
                pieces.append(lone if lone.isascii() else self.spelt(lone))
                if mark:
                    pieces.append(mark)
            else:
                pieces += [self.spelt(p) for p in self.split(lower)]
            plain.append(i)
            upto.append(len(pieces))
        width = self.kind.itemsize
        if pieces:
            ids = np.array(self.merges.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
            if len(ends) != len(pieces) + 1:
                raise ValueError("some piece has no id that ends it")
            cuts, blob = (ends[upto] * width).tolist(), ids.tobytes()
            for i, a, b in zip(plain, cuts, cuts[1:]):
                out[i] = blob[a:b]
        if others:
            for i, found in zip(others, self.tokenizer.encode_batch_fast([words[i].decode() for i in others], add_special_tokens=False)):
                out[i] = np.array(found.ids, self.kind).tobytes()
        return out

    def known(self, words: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS // 2:
            self.words, self.before = {}, self.words
        new, old = self.words, self.before
        found = list(map(new.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        for i in missing:
            if (f := old.get(words[i])) is not None:
                found[i] = new[words[i]] = f
        missing = [i for i in missing if found[i] is None]
        # The library's own record of what it encodes is many times its size.
        for at in range(0, len(missing), WORDS_AT_ONCE):
            some = missing[at : at + WORDS_AT_ONCE]
            for i, f in zip(some, self.encoded([words[i] for i in some])):
                found[i] = new[words[i]] = f
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        if not self.by_word:
            each = [np.array(f.ids + self.end, self.kind) for f in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(each or [np.zeros(0, self.kind)]), np.cumsum([len(e) for e in each])
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        found = self.known(values(coded.dictionary))
        found.append(np.array(self.end, self.kind).tobytes())
        table = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        places = np.cumsum(sizes) - sizes
        # Each text's words, then the end id.
        n_words = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        index = np.insert(coded.indices.to_numpy(), np.cumsum(n_words), len(found) - 1)
        lengths = sizes[index]
        upto = np.cumsum(lengths)
        picks = np.repeat(places[index] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)
        return table[picks], upto[np.cumsum(n_words + 1) - 1]


def values(column: pa.Array) -> list[bytes]:
    """The bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    blob = data.to_pybytes() if data else b""
    return [blob[a:b] for a, b in zip(ends, ends[1:])]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """One a worker process."""
    let_go_of_others("token_output")
    if (path, end_id) not in _encoders:
        keeps("token_output", _encoders.clear)
        _encoders[path, end_id] = Encoder(path, end_id)
        give_back()
    return _encoders[path, end_id]


def binary(blobs: list) -> pa.Array:
    return pa.array([bytes(b) for b in blobs], pa.binary())


def sliced(batch: pa.RecordBatch, rows: int, by: str | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of batch of few rows and, where by names a text or binary column, of about most bytes."""
    at = 0
    sizes = [len(x) if (x := v.as_buffer()) else 0 for v in batch.column(by)] if by else [0] * batch.num_rows
    while at < batch.num_rows:
        end, held = at, 0
        while end < batch.num_rows and end - at < rows and (end == at or held + sizes[end] <= most):
            held += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def tokenized(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers, or 16-bit ones where all ids fit.

    Null and empty texts give the end id alone. Other columns of docs are left out.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for whole in batches:
            for batch in sliced(whole, 4096, "text", SLICE_BYTES):
                ids, ends = encode(batch.column("text"))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                blobs = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(ends - starts, pa.int64()), binary(blobs)], names=["doc_id", "n_tokens", "ids"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(held.dtypes)["doc_id"]
    return held.mapInArrow(tidy(tokenize), f"doc_id {kind}, n_tokens long, ids binary")


def numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u4" if n and len(blob) == 4 * n else "<u2")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs. Each task sends one row an id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for n, blob in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()):
                found = np.bincount(numbers(blob, n))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counted = tokens.select("n_tokens", "ids").mapInArrow(count, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Best code lengths of at most max_bits by package-merge: one id more costs nothing, so any counts work."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    if len(counts) > 1 << max_bits:
        raise ValueError(f"{len(counts)} ids don't fit code words of {max_bits} bits")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    leaves = np.array([counts[i] for i in ids], dtype=np.float64)
    # At each level, is the k-th cheapest item a leaf or a package of two items of the level below?
    kinds: list[np.ndarray] = []
    items = leaves
    kinds.append(np.ones(n, dtype=bool))
    for _ in range(max_bits - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        order = np.argsort(merged, kind="stable")
        items = merged[order]
        kinds.append(order < n)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return dict(zip(ids, lengths.tolist()))


class Code:
    """Canonical code words: shorter first, then by id."""

    def __init__(self, lengths: dict[int, int], max_bits: int = MAX_BITS):
        self.max_bits = max_bits
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        size = max(order, default=0) + 1
        self.words, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.table_id, self.table_bits = np.zeros(1 << max_bits, np.uint32), np.zeros(1 << max_bits, np.int64)
        word = last = 0
        for i in order:
            word <<= lengths[i] - last
            last = lengths[i]
            self.words[i], self.bits[i] = word, last
            first = word << (max_bits - last)
            self.table_id[first : first + (1 << (max_bits - last))] = i
            self.table_bits[first : first + (1 << (max_bits - last))] = last
            word += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the first bit of every block."""
        words, bits = self.words[ids], self.bits[ids]
        upto = np.cumsum(bits)
        at = upto - bits
        cell, end = (at >> np.uint64(5)).astype(np.int64), (at & np.uint64(31)) + bits
        cells = int((upto[-1] + np.uint64(31)) >> np.uint64(5)) if len(ids) else 0
        pair = words << (np.uint64(64) - end)  # the code word in the two cells that it may touch
        out = np.bincount(cell, weights=(pair >> np.uint64(32)).astype(np.float64), minlength=cells + 1)
        out[: cells + 1] += np.bincount(cell + 1, weights=(pair & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells + 1)[: cells + 1]
        n_bytes = int((upto[-1] + np.uint64(7)) >> np.uint64(3)) if len(ids) else 0
        return out.astype(np.uint64).astype(">u4").tobytes()[:n_bytes], at[::BLOCK].astype(np.int64)

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], n_ids: list[int]) -> np.ndarray:
        """The ids of all payloads, one after another. All their blocks are read side by side."""
        total = sum(n_ids)
        data = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8).astype(np.int64)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        starts = np.cumsum([0, *(len(p) for p in payloads)])[:-1] * 8
        at = np.concatenate([s + np.asarray(c, dtype=np.int64) for s, c in zip(starts, checkpoints)] or [np.zeros(0, np.int64)])
        firsts = np.cumsum([0, *n_ids])[:-1]
        slot = np.concatenate([f + BLOCK * np.arange(len(c)) for f, c in zip(firsts, checkpoints)] or [np.zeros(0, np.int64)])
        left = np.concatenate([np.minimum(BLOCK, n - BLOCK * np.arange(len(c))) for n, c in zip(n_ids, checkpoints)] or [np.zeros(0, np.int64)])
        order = np.argsort(-left, kind="stable")
        at, slot, left = at[order], slot[order], left[order]
        out, shift, mask = np.zeros(total, np.uint32), 32 - self.max_bits, (1 << 32) - 1
        for step in range(int(left.max(initial=0))):
            if left[-1] <= step:
                live = int(np.searchsorted(-left, -step, side="left"))
                at, slot, left = at[:live], slot[:live], left[:live]
            seen = ((windows[at >> 3] << (at & 7)) & mask) >> shift
            out[slot + step] = self.table_id[seen]
            at = at + self.table_bits[seen]
        return out


def range_cuts(keys: DataFrame, key: str, n: int) -> list:
    """At most n - 1 values that cut the keys into even ranges, from the one column."""
    if n < 2:
        return []
    found = keys.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(x) for x in found})


def write_encoded(tokens: DataFrame, path: str) -> dict[int, int]:
    """Writes tokens (doc_id, n_tokens, ids) under path and returns the code's lengths.

    Two passes over the ids: global counts, which have at most one row an id of the vocabulary, give the code;
    then each document is encoded, and what is left of it moves to its shard.
    """
    spark = tokens.sparkSession
    counts = {r.id: r.n for r in id_counts(tokens).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(b)) for i, b in sorted(lengths.items())] or [], "id long, bits int").write.parquet(f"{path}/code")
    total = sum(counts.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_IDS))
    cuts = range_cuts(tokens.select("doc_id"), "doc_id", n)
    shared = spark.sparkContext.broadcast((lengths, cuts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cuts = shared.value
        code = Code(lengths)
        for whole in batches:
            for batch in sliced(whole, 512, "ids"):
                ids = batch.column("doc_id").to_pylist()
                n_ids = batch.column("n_tokens").to_pylist()
                coded = [code.encode(numbers(b, k)) for b, k in zip(batch.column("ids").to_pylist(), n_ids)]
                shards = [0 if i is None else bisect.bisect_right(cuts, i) for i in ids]
                yield pa.record_batch(
                    [pa.array(shards, pa.int32()), batch.column("doc_id"), batch.column("n_tokens"), pa.array([c.astype("<i8").tobytes() for _, c in coded], pa.binary()), binary([p for p, _ in coded])],
                    names=["shard", "doc_id", "n_tokens", "checkpoints", "payload"],
                )

    kind = dict(tokens.dtypes)["doc_id"]
    coded = tokens.mapInArrow(tidy(encode), f"shard int, doc_id {kind}, n_tokens long, checkpoints binary, payload binary")
    placed = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", F.crc32("payload"))
    placed.write.option("compression", "none").parquet(f"{path}/shards")
    return lengths


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, n_tokens, ids_crc32, payload_crc32 from the ids that the files decode to."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{path}/code").collect()}
    shared = spark.sparkContext.broadcast(lengths)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for whole in batches:
            for batch in sliced(whole, 1024, "payload", BATCH_IDS):
                n_ids = batch.column("n_tokens").to_pylist()
                points = [np.frombuffer(b, "<i8") for b in batch.column("checkpoints").to_pylist()]
                ids = code.decode(batch.column("payload").to_pylist(), points, n_ids).astype("<u4")
                ends = np.cumsum(n_ids)
                sums = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends, n_ids)]
                stored_sums = [zlib.crc32(b) for b in batch.column("payload").to_pylist()]
                columns = [batch.column("shard"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(sums, pa.int64()), pa.array(stored_sums, pa.int64())]
                yield pa.record_batch(columns, names=["shard", "doc_id", "n_tokens", "ids_crc32", "payload_crc32"])

    files = spark.read.parquet(f"{path}/shards")
    kind = dict(files.dtypes)["doc_id"]
    return files.mapInArrow(tidy(digest), f"shard int, doc_id {kind}, n_tokens long, ids_crc32 long, payload_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as token ids and returns, read back from the files: doc_id, start, n_tokens, ids_crc32, shard.

    start counts the ids of all documents before this one by doc_id. Null and empty texts have the
    end id alone. Null ids come first. Repeated rows are written each for itself, in the order of their
    code. An empty table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-output")
    write_encoded(stored(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "token-ids"), path)
    read = stored(read_digests(spark, path), "token-digests")
    within = W.partitionBy("shard").orderBy("doc_id", "n_tokens", "payload_crc32").rowsBetween(W.unboundedPreceding, -1)
    starts = part_starts(read, "shard", F.col("n_tokens"))  # a row a shard
    placed = read.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(starts), "shard")
    return placed.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
