"""Chat formatting into a prefix tree.

A turn is formatted as ``### role:\\n``, its text and ``</turn>\\n``. Conversations that begin with the same turns share those
turns' tokens: a node of the tree is one turn after one history, named by a digest of both. Conversations are put in an
order in which those that share a history stand together; each node belongs to the first conversation that has it,
and the nodes by owner and depth are the tree depth first. That is a sort of short keys, so a tree of any
size spreads over all tasks, and no row holds more than its own turn.

Every node row carries its place in the stream, the position of its first token (which counts its ancestors' tokens,
not the stream's), a loss mask by token, and the stream intervals of its ancestors: what its tokens may attend to
besides themselves. Ancestors of one owner lie side by side and are one interval.

Control strings inside texts are marked with a backslash, and backslashes too, which ``unescaped`` takes back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import in_order, part_starts, stored

OPEN, CLOSE = "###", "</turn>"
ASSISTANT = "assistant"
_MARKED = re.compile(r"\\(\\|###|</turn>|n)")


def escaped(text: str) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _MARKED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text as written, and what stands after it."""
    return f"{OPEN} " + escaped(role).replace("\n", "\\n") + ":\n", escaped(text), f"{CLOSE}\n"


def turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, first and last character of the text as written) of each turn in formatted."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(f"{OPEN} ", at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at) - 1
        role = unescaped(formatted[at + len(OPEN) + 1 : line])
        begin = end = line + 2
        while not formatted.startswith(CLOSE, end):
            if formatted[end] == "\\":
                end += 1 + len(CLOSE if formatted.startswith(CLOSE, end + 1) else OPEN if formatted.startswith(OPEN, end + 1) else "\\")
            else:
                following = min(x for x in (formatted.find("\\", end), formatted.find(CLOSE, end)) if x >= 0)
                end = following
        yield role, unescaped(formatted[begin:end]), begin, end
        at = end + len(CLOSE) + 1


_tokenizers: dict = {}


def tokenizer(path: str):
    """A byte-level tokenizer whose special strings are ordinary text inside turns; one a worker process.

    It runs on the task's own core: threads of its own would each hold memory that the executor doesn't know of.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _tokenizers[path] = made
    return _tokenizers[path]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows: a tokenizer's answers are many times larger than its texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def turn_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(line, conv, depth, node, role, text): the turns of each conversation counted from 1 and named by their history.

    Turns are in order of turn, role and text; null comes first, and null roles and texts count as empty. line names the
    conversation and is never null: nothing ties rows without an id together, so each is a conversation of its own. Rows of a
    conversation stream through one task in order, which keeps the last digest and nothing else.
    """
    conv = F.col(id_col)
    line = F.when(conv.isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(F.concat(F.lit("+"), conv.cast("string")))
    held = conversations.select(
        line.alias("line"), conv.alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    names = ["line", "conv", "depth", "node", "role", "text"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, depth, digest = None, 0, b""
        for batch in batches:
            depths, nodes = [], []
            for at, role, text in zip(*(batch.column(c).to_pylist() for c in ("line", "role", "text"))):
                if at != line:
                    line, depth, digest = at, 0, b""
                depth += 1
                own = hashlib.sha256(b"%d:" % len(role) + role.encode() + text.encode()).digest()
                digest = hashlib.sha256(digest + own).digest()[:16]
                depths.append(depth)
                nodes.append(digest)
            columns = [batch.column("line"), batch.column("conv"), pa.array(depths, pa.int32()), pa.array(nodes, pa.binary()), batch.column("role"), batch.column("text")]
            yield pa.record_batch(columns, names=names)

    ordered = held.repartition("line").sortWithinPartitions("line", "turn", "role", "text")
    return ordered.mapInArrow(chain, f"line string, conv {dict(held.dtypes)['conv']}, depth int, node binary, role string, text string")


def encoded_nodes(nodes: DataFrame, tokenizer_path: str) -> DataFrame:
    """nodes with ids (little-endian 32-bit), loss (a byte a token) and n_tokens. Only assistant texts are learnt."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in in_slices(batches):
            written = [parts(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            found = tok.encode_batch_fast([p for three in written for p in three], add_special_tokens=False)
            ids, loss, counts = [], [], []
            for i, role in enumerate(batch.column("role").to_pylist()):
                three = [f.ids for f in found[3 * i : 3 * i + 3]]
                ids.append(np.array([x for part in three for x in part], "<u4").tobytes())
                loss.append(bytes(len(three[0])) + bytes([role == ASSISTANT]) * len(three[1]) + bytes(len(three[2])))
                counts.append(len(loss[-1]))
            columns = [*(batch.column(c) for c in ("node", "n_turns", "depth")), pa.array(ids, pa.binary()), pa.array(loss, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.record_batch(columns, names=["node", "n_turns", "depth", "ids", "loss", "n_tokens"])

    return nodes.select("role", "text", "node", "n_turns", "depth").mapInArrow(encode, "node binary, n_turns long, depth int, ids binary, loss binary, n_tokens long")


def leaf_order(slim: DataFrame, shared: DataFrame) -> DataFrame:
    """(line, part, part_row) for slim (line, depth, node): conversations in an order that keeps any shared history together.

    The key is the path through shared nodes and the last node, so turns that nobody else has cost nothing.
    """
    met = slim.join(shared.withColumn("shared", F.lit(True)), "node", "left")
    keys = met.groupBy("line").agg(
        F.array_sort(F.collect_list(F.when(F.col("shared"), F.struct("depth", "node")))).alias("path"), F.max(F.struct("depth", "node")).alias("leaf")
    )
    keys = stored(keys.select("line", F.concat("path.node", F.array("leaf.node")).alias("path")), "paths")
    return in_order(keys, [F.col("path"), F.col("line")], "leaves").select("line", "part", "part_row")


def prefix_tree(
    conversations: DataFrame, tokenizer_path: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(stream, turns), both read from stored tables.

    stream, a row a node, its files in depth-first order: node, depth, start, n_tokens, ids, loss, position (of its first
    token), ancestors (array of structs start, end: their intervals in the stream, root first). turns, a row a turn of each
    conversation: line, conv, depth, start, end (its interval in the stream).

    Null texts and roles count as empty; each row with a null conversation id is a conversation of its own. Repeated rows
    are turns of their own. An empty table gives two empty ones. Other columns are not looked at.
    """
    rows = stored(turn_rows(conversations, id_col, turn_col, role_col, text_col), "turns")
    slim = rows.select("line", "depth", "node")
    # Copies of a turn are merged by its digest before it is tokenized, once.
    nodes = rows.groupBy("node").agg(F.first(F.struct("role", "text", "depth")).alias("n"), F.count("*").alias("n_turns"))
    encoded = stored(encoded_nodes(nodes.select("node", "n_turns", "n.*"), tokenizer_path), "nodes")
    order = leaf_order(slim, encoded.where("n_turns > 1").select("node"))
    owners = slim.join(order, "line").groupBy("node").agg(F.min(F.struct("part", "part_row", "line")).alias("at"))
    spots = encoded.select("node", "depth", "n_tokens").join(owners, "node").select("node", "depth", "n_tokens", "at.part", "at.part_row", F.col("at.line").alias("owner"))
    before = F.sum("n_tokens").over(W.partitionBy("part").orderBy("part_row", "depth").rowsBetween(W.unboundedPreceding, -1))
    spots = stored(spots.withColumn("before", F.coalesce(before, F.lit(0))), "spots")
    starts = part_starts(spots, "part", F.col("n_tokens"))  # a row a part
    start = F.col("part_start") + F.col("before")
    spots = spots.join(F.broadcast(starts), "part").select("node", "owner", "n_tokens", start.alias("start"), (start + F.col("n_tokens")).alias("end"))
    # Each turn's interval, by conversation; a node of very many conversations is a hot key that the join may split.
    turns_at = rows.select("line", "conv", "depth", "node").join(spots.select("node", "owner", "start", "end"), "node")
    turns_at = stored(turns_at.select("line", "conv", "depth", "owner", "start", "end"), "placed")
    runs = turns_at.groupBy("line", "owner").agg(F.min("depth").alias("depth"), F.min("start").alias("start"), F.max("end").alias("end"))
    heads = runs.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "end", "owner"))).alias("runs"))
    heads = heads.select(
        F.col("line").alias("owner"),
        F.transform(F.filter("runs", lambda x: x["owner"] != F.col("line")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("above"),
        F.get(F.filter("runs", lambda x: x["owner"] == F.col("line")), F.lit(0))["start"].alias("begin"),
    )
    own = F.struct(F.col("begin").alias("start"), F.col("start").alias("end"))
    ancestors = F.when(F.col("start") > F.col("begin"), F.concat("above", F.array(own))).otherwise(F.col("above"))
    position = F.aggregate("above", F.col("start") - F.col("begin"), lambda a, x: a + x["end"] - x["start"])
    # Shards of the stream hold about as many tokens each, however the conversations lie in parts.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 1
    shard = F.least(F.floor(F.col("start") * F.lit(parts) / F.lit(total)), F.lit(parts - 1)).cast("int")
    where = spots.join(heads, "owner").select("node", shard.alias("shard"), "start", position.alias("position"), ancestors.alias("ancestors"))
    stream = encoded.drop("n_turns").join(where, "node").repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "start")
    stream = stream.select("node", "depth", "start", "n_tokens", "ids", "loss", "position", "ancestors")
    return stored(stream, "stream"), turns_at.select("line", "conv", "depth", "start", "end")


def conversation_digests(stream: DataFrame, turns_at: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the stream through each turn's interval.

    The turns of a conversation stream through one task, which keeps its running digests and no text.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for batch in in_slices(batches):
            ids = [np.frombuffer(b, "<u4") for b in batch.column("ids").to_pylist()]
            loss = [np.frombuffer(b, np.uint8) for b in batch.column("loss").to_pylist()]
            text = tok.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
            learnt = tok.decode_batch([i[m > 0].tolist() for i, m in zip(ids, loss)], skip_special_tokens=False)
            yield pa.record_batch([batch.column("start"), pa.array(text), pa.array(learnt)], names=["start", "written", "learnt"])

    spelt = stored(stream.select("start", "ids", "loss").mapInArrow(spell, "start long, written string, learnt string"), "spelt")
    conv = dict(turns_at.dtypes)["conv"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, held, kind = None, None, None

        def done(rows: list) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

        def closed() -> tuple:
            conv, n, said, n_loss, loss, n_chars = held
            return conv, n, said.hexdigest(), n_loss, loss.hexdigest(), n_chars

        for batch in batches:
            rows, kind = [], batch.schema.field("conv").type
            for at, conv, written, learnt in zip(*(batch.column(c).to_pylist() for c in ("line", "conv", "written", "learnt"))):
                if at != line:
                    if held:
                        rows.append(closed())
                    line, held = at, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in turns(written):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                loss = unescaped(learnt)
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += len(written)
            yield done(rows)
        if held:
            yield done([closed()])

    whole = turns_at.join(spelt, "start").select("line", "depth", "conv", "written", "learnt")
    whole = whole.repartition("line").sortWithinPartitions("line", "depth")
    return whole.mapInArrow(digest, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
