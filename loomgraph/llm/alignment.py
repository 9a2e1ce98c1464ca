"""Alignment of two tokenizers over the same texts, and how surely a token of one stands for one of the other.

Both tokenizers cut the bytes of a text. Where tokens of both end at the same byte, a group ends. Ends are compared as arrays, by diagonal runs: at
the current shift between the two indices, ends are compared in stretches of doubling length until they differ.
All that agrees are groups of one token each; the irregular group behind is resolved by stepping along the lesser end, and
gives the new shift.

Tokens of a group are linked, each of one side with each of the other. Links are kept by document as distinct pairs with their number, pairs are counted over
documents before they are moved, and the counts come back by one of two ways that give the same: as a broadcast table where their
number has been checked, else by a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, stored

#: Pairs that are broadcast at most: 16 bytes each.
MOST_PAIRS = 2_000_000
#: Ids of the second tokenizer in a pair's number.
WIDE = 1 << 32
#: Parts of texts that a worker keeps at most for a tokenizer.
MOST_PARTS = 400_000
#: Bytes of text that are encoded at once.
_SLICE = 1 << 21
#: Links of one group that are written out one by one; those of larger groups are counted by id.
_WRITTEN = 4096


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies spell bytes with: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file, special strings being ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model, which puts a space before each text: its tokens spell texts that begin with one."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.behind = len(self.model.encode("\n"))
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # What has no space before it is encoded behind a line break, which no piece has (see Pair). A space alone would be no text to the model.
        found = self.model.encode([t[1:] if t[:1] == " " else "\n" + t for t in texts], num_threads=1)
        return [[self.space] if t == " " else ids if t[:1] == " " else ids[self.behind :] for t, ids in zip(texts, found)]


class Pair:
    """Ids by two tokenizers of texts that begin with a space, None where tokens of either do not spell the text.

    Texts of plain letters are cut into parts, and each distinct part is encoded once, by the libraries. The cut is that of byte-level tokenizers. The other's merges make
    pieces, so none crosses between two characters that no piece has side by side: where each of its pieces holds letters or digits or other characters
    alone, after spaces, it keeps within the same parts. Texts in which the two would cut differently (spaces in a row, letters behind a contraction), or with characters that libraries may class
    differently, are encoded whole.
    """

    LETTER, DIGIT = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", "[0-9]"
    CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?{LETTER}+| ?{DIGIT}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    WHOLE = re.compile(rf"[^\n -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]|  |'(?:s|t|re|ve|m|ll|d){LETTER}| $")

    def __init__(self, path_a: str, path_b: str) -> None:
        self.both = [ByteLevel(p) if p.endswith(".json") else Pieces(p) for p in (path_a, path_b)]
        kinds = [type(t) for t in self.both]
        self.cuts = kinds == [ByteLevel, Pieces] and all(self.alike(p.lstrip("▁")) for p in self.both[1].plain)
        self.parts: dict[str, tuple[bytes | None, ...]] = {}

    def alike(self, piece: str) -> bool:
        """Whether the characters of piece are of one kind."""
        if "▁" in piece or "\n" in piece:
            return False
        return len({(re.match(self.LETTER, c) is None) + (re.match(r"\d|[\xb2\xb3\xb9\xbc-\xbe]", c) is None) * 2 for c in piece if not self.WHOLE.search(c)}) < 2

    @staticmethod
    def checked(tokenizer: ByteLevel | Pieces, texts: list[str]) -> list[bytes | None]:
        """For each text its ids as 4-byte integers."""
        spelled = lambda text, ids: b"".join(map(tokenizer.bytes.__getitem__, ids)) == text.encode()
        return [np.array(ids, "<u4").tobytes() if spelled(text, ids) else None for text, ids in zip(texts, tokenizer.encode(texts))]

    def words(self, tokenizer: ByteLevel | Pieces, words: list[str]) -> list[bytes | None]:
        """The ids of words that each begin with a space: encoded some hundred at a time, as one text that falls apart at these spaces again."""
        out: list[bytes | None] = []
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            text = "".join(some)
            ids = np.array(tokenizer.encode([text])[0], "<u4")
            token_ends, ends = np.cumsum(tokenizer.lengths[ids]), np.cumsum([len(w.encode()) for w in some])
            upto = np.searchsorted(token_ends, ends) + 1
            if b"".join(map(tokenizer.bytes.__getitem__, ids.tolist())) == text.encode() and (token_ends[upto - 1] == ends).all():
                raw, bounds = ids.tobytes(), [0, *(4 * upto).tolist()]
                out += [raw[p:q] for p, q in zip(bounds[:-1], bounds[1:])]
            else:
                out += self.checked(tokenizer, some)
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        if len(self.parts) > MOST_PARTS:
            self.parts = {}
        parts = self.parts
        cut = [self.CUT.findall(t) if self.cuts and not self.WHOLE.search(t) else None for t in texts]
        new = {w for ws in cut if ws for w in ws if w not in parts}
        words = [w for w in new if w[0] == " " and w[1:].isalpha()]
        rest = list(new.difference(words))
        parts.update(zip(words, zip(*(self.words(t, words) for t in self.both))))
        parts.update(zip(rest, zip(*(self.checked(t, rest) for t in self.both))))
        alone = [t for t, ws in zip(texts, cut) if ws is None]
        whole = iter([*zip(*(self.checked(t, alone) for t in self.both))])
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for ws in cut:
            held = [next(whole)] if ws is None else list(map(parts.__getitem__, ws))
            both = [[h[k] for h in held] for k in (0, 1)]
            out.append(None if any(None in raw for raw in both) else tuple(np.frombuffer(b"".join(raw), "<u4").astype(np.int64) for raw in both))
        return out


@lru_cache(maxsize=2)
def loaded(path_a: str, path_b: str) -> Pair:
    """The tokenizers of two files, read once a worker: JSON files are byte-level, others are models of pieces."""
    return Pair(path_a, path_b)


#: Ends that are compared first.
_PROBE = 32


def agreeing(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many of the ends from i in a and from j in b agree one by one, compared in stretches of doubling length."""
    good, step = 0, _PROBE
    while True:
        x, y = a[i + good : i + good + step], b[j + good : j + good + step]
        n = min(len(x), len(y))
        if not n:
            return good
        unlike = x[:n] != y[:n]
        at = int(unlike.argmax())
        if unlike[at]:
            return good + at
        good += n
        step += step


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the ascending ends a and b of tokens, whose last are equal: how many tokens of each lie before the end of each group."""
    # Only irregular groups are looked at one by one; as lists, their ends are plain integers.
    u, v = a.tolist(), b.tolist()
    n, m, i, j = len(u), len(v), 0, 0
    starts_i, starts_j, lengths = [], [], []
    while i < n:
        run = agreeing(a, b, i, j)
        starts_i.append(i)
        starts_j.append(j)
        lengths.append(run)
        i += run
        j += run
        if i >= n:
            break
        p, q = u[i], v[j]
        while p != q:
            if p < q:
                i += 1
                p = u[i]
            else:
                j += 1
                q = v[j]
        i += 1
        j += 1
    # A run gives a group for each of its tokens; the irregular group behind it ends where the next run starts.
    starts_i.append(n)
    starts_j.append(m)
    runs = np.array(lengths, np.int64)
    groups = runs + 1
    rank = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    last = rank == np.repeat(runs, groups)
    ends = []
    for starts in (np.array(starts_i, np.int64), np.array(starts_j, np.int64)):
        ends.append(np.where(last, np.repeat(starts[1:], groups), np.repeat(starts[:-1], groups) + rank + 1))
    # Behind the last run there may be no irregular group.
    most = len(rank) - (len(runs) > 0 and starts_i[-2] + lengths[-1] == n)
    return ends[0][:most], ends[1][:most]


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct pairs of linked ids (as id of a * WIDE + id of b), how often each is linked, and the number of links."""
    p, q = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    small = p * q <= _WRITTEN
    first_a, first_b = (ends_a - p)[small], (ends_b - q)[small]
    ps, qs = p[small], q[small]
    n = ps * qs
    group = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    keys = a[first_a[group] + inside // qs[group]] * WIDE + b[first_b[group] + inside % qs[group]]
    found, times = np.unique(keys, return_counts=True)
    for g in np.flatnonzero(~small):
        ka, na = np.unique(a[ends_a[g] - p[g] : ends_a[g]], return_counts=True)
        kb, nb = np.unique(b[ends_b[g] - q[g] : ends_b[g]], return_counts=True)
        found = np.concatenate([found, (ka[:, None] * WIDE + kb[None, :]).ravel()])
        times = np.concatenate([times, (na[:, None] * nb[None, :]).ravel()])
        found, back = np.unique(found, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, back, times)
        times = sums
    return found, times, int((p * q).sum())


class Speller:
    """Groups in decimal ids: a1,a2|b1;a3|b2,b3."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.places = 0, n_a, 2 * n_a, 2 * n_a + n_b
        self.pieces = [f"{k}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for k in range(n)]

    def spell(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        if not len(ends_a):
            return ""
        order = np.zeros(len(a) + len(b), np.int64)
        for ids, ends, before, first in ((a, ends_a, np.concatenate([[0], ends_b[:-1]]), 0), (b, ends_b, ends_a, 2)):
            inner, last = self.places[first : first + 2]
            kind = np.full(len(ids), inner)
            kind[ends - 1] = last
            order[np.arange(len(ids)) + np.repeat(before, np.diff(ends, prepend=0))] = ids + kind
        return "".join(map(self.pieces.__getitem__, order.tolist()))[:-1]


def aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times [, groups]) of docs (id, text), a row each.

    The first tokenizer gets a space and the text, the second the text. pairs and times hold the distinct linked pairs as 8-byte integers and how
    often each is linked. Texts that are null or empty, or whose tokens do not spell them, have no tokens.
    """
    kinds = f"id {dict(docs.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    nothing = (0, 0, 0, 0, "", b"", b"", "")

    def align(text: str, ids: tuple[np.ndarray, np.ndarray] | None, pair: Pair, speller: Speller) -> tuple:
        if not text or ids is None:
            return nothing
        a, b = ids
        ends_a, ends_b = group_ends(*(np.cumsum(t.lengths[k]) for t, k in zip(pair.both, ids)))
        pairs, times, n_links = linked(a, b, ends_a, ends_b)
        groups = speller.spell(a, b, ends_a, ends_b)
        held = pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes()
        return len(a), len(b), len(ends_a), n_links, hashlib.sha256(groups.encode()).hexdigest(), *held, groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(path_a, path_b)
        speller = Speller(*(len(t.bytes) for t in pair.both))
        names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * keep_groups
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * keep_groups
        for batch in batches:
            texts, first, size = [], 0, 0
            for at, cell in enumerate(batch.column("text")):
                texts.append(cell.as_py() or "")
                size += len(texts[-1])
                if size < _SLICE and at + 1 < batch.num_rows:
                    continue
                rows = [align(t, ids, pair, speller) for t, ids in zip(texts, pair.encode([" " + t for t in texts]))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), types)]
                yield pa.record_batch([batch.column("id").slice(first, len(texts)), *columns], names=["id", *names])
                texts, first, size = [], at + 1, 0

    return docs.select("id", "text").mapInArrow(run, kinds + (", groups string" if keep_groups else ""))


def pair_rows(held: DataFrame, *keep: str) -> DataFrame:
    """keep, pair, n: a row for each distinct pair of each row of held (pairs, times)."""
    kinds = dict(held.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [[x.as_py() for x in part.column(c)] for c in ("pairs", "times")]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(x) // 8 for x in raw[0]]))
                columns = [part.column(c).take(of) for c in keep] + [pa.array(np.frombuffer(b"".join(x), "<i8")) for x in raw]
                yield pa.record_batch(columns, names=[*keep, "pair", "n"])

    return held.select(*keep, "pairs", "times").mapInArrow(cut, "".join(f"{c} {kinds[c]}, " for c in keep) + "pair long, n long")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows of held a pair is linked, and whether that is its first id's highest number.

    Counted in each task before anything is moved. An id's highest numbers are one row an id of a vocabulary.
    """
    counts = pair_rows(held).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def told(held: DataFrame, counts: DataFrame, most_pairs: int) -> DataFrame:
    """(row, n_best, count_sum) of held (row, pairs, times): sums over each row's links; rows without links may lack."""
    if counts.count() > most_pairs:
        met = pair_rows(held, "row").join(counts, "pair")
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    table = counts.toArrow()  # at most most_pairs rows
    key = table.column("pair").to_numpy()
    order = np.argsort(key)
    shared = held.sparkSession.sparkContext.broadcast((key[order], table.column("docs").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [[x.as_py() for x in part.column(c)] for c in ("pairs", "times")]
                pairs, n = (np.frombuffer(b"".join(x), "<i8") for x in raw)
                ends = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw[0]])]).astype(np.int64)
                place = np.searchsorted(keys, pairs)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[place], n * docs[place])]
                columns = [pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums]
                yield pa.record_batch([part.column("row"), *columns], names=["row", "n_best", "count_sum"])

    return held.select("row", "pairs", "times").mapInArrow(look, "row long, n_best long, count_sum long")


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 [, groups]: a row for each row of docs.

    n_best counts the links whose pair is in as many rows as any pair of the same first id, count_sum sums those numbers over links. Null and
    empty texts, and those that a tokenizer does not spell back, have zeros and ''. Rows that share an id, or have none, are told apart and count one each.
    An empty table gives an empty one. Other columns are not looked at.
    """
    held = aligned(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), path_a, path_b, keep_groups)
    # Rows are numbered in the very step that stores them, so the numbers stay.
    held = stored(held.withColumn("row", F.monotonically_increasing_id()), "aligned")
    sums = told(held, pair_counts(held), most_pairs)
    groups = ["groups"] if keep_groups else []
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    met = held.drop("pairs", "times").join(sums, "row", "left")
    return met.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *groups)
