"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared in lower case with one space for everything that is neither letter nor digit. An item of n characters
may be up to n // CHARS_PER_EDIT edits away. Cut into one piece more than that, it leaves at least one piece
untouched in any passage so close to it, so an Aho-Corasick automaton over all pieces finds every
candidate in one pass over the text, and Myers' bit-parallel distance decides around each. Items of less than
MIN_CHARS characters are one piece and must stand in the text as whole words, without an edit.

The automaton covers a block of items of BLOCK_CHARS characters in all, which bounds what is broadcast; a larger benchmark takes
further passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import tidy

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Items with fewer characters are matched exactly, at word limits.
MIN_CHARS = 20
BLOCK_CHARS = 1_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(n_chars: int, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS) -> int:
    return n_chars // chars_per_edit if n_chars >= min_chars else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about one length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def closest(masks: dict[str, int], n: int, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of text, and where the first such stretch ends.

    Myers' algorithm with one integer of n bits a column. (most + 1, -1) if all are further away.
    """
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, most + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        up <<= 1
        plus = ((down << 1) | ~(vertical | up)) & full
        minus = up & vertical & full
    return best, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[object, str]], chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = [(i, t, budget(len(t), chars_per_edit, min_chars), letter_masks(t)) for i, t in items]
        self.short = [len(t) < min_chars for _, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, edits, _) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                places[piece].append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[object, int, int]]:
        """(item, distance, end in the normalised text), the closest stretch for each item within its budget."""
        starts: dict[int, set[int]] = defaultdict(set)
        words: dict[int, int] = {}
        for end, where in self.automaton.iter(text):
            for k, inside in where:
                begin = end + 1 - inside  # where the item would begin
                if not self.short[k]:
                    starts[k].add(begin)
                elif k not in words and text[begin - 1 : begin] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                    words[k] = end + 1
        found = [(self.items[k][0], 0, at) for k, at in words.items()]
        for k, begins in starts.items():
            item, pattern, edits, masks = self.items[k]
            n, best, at = len(pattern), edits + 1, -1
            low = high = None
            for begin in [*sorted(begins), None]:
                if low is not None and (begin is None or begin - high > n + 2 * edits):
                    a, b = max(0, low - edits), high + n + edits
                    whole = text.find(pattern, a, b)
                    if whole >= 0:
                        best, at = 0, whole + n
                    else:
                        distance, end = closest(masks, n, text[a:b], best - 1)
                        if end >= 0:
                            best, at = distance, a + end
                    low = None
                    if not best:
                        break
                if low is None:
                    low = begin
                high = begin
            if at >= 0:
                found.append((item, best, at))
        return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, in blocks of about block_chars characters. Items without a letter or digit say nothing and are left out."""
    held = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = held.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for block in range(n):
        rows = held.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block).distinct().collect()  # bounded: one block
        yield [(r.item, t) for r in rows if (t := normalised(r.text))]


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, distance, end: a row for each item that a document holds within the item's budget.

    end counts characters of the normalised text. Null and empty texts hold nothing; null ids, of documents and of items, are
    kept as they are; items' ids may have any type; each of repeated rows gives its own. Among equally close stretches the first counts. Empty
    tables give an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = f"doc_id {dict(held.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)[item_col]}, distance int, end long"
    found = None
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, chars_per_edit, min_chars)
            for batch in batches:
                schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("item_id", item_kind), ("distance", pa.int32()), ("end", pa.int64())])
                rows = [(i.as_py(), *leak) for i, t in zip(batch.column("doc_id"), batch.column("text")) for leak in (matcher.leaks(normalised(t.as_py())) if shared.value else [])]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, schema)], schema=schema)

        one = held.mapInArrow(tidy(match), kinds)
        found = one if found is None else found.union(one)
    return found


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of docs that hold no item, whole and with all their columns. Null and empty texts stay, and all do where there are no items."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        if not items:
            continue
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, chars_per_edit, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.leaks(normalised(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs
