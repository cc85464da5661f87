"""Chat formatting into a prefix tree: conversations that begin alike share their first turns.

A turn is formatted alone, with marks for its role, so a conversation's formatted text is the concatenation of its
turns. Control strings inside texts are broken by an escape and restored by :func:`unescaped`. A token is one code point
of the formatted text.

A node is a conversation's beginning, named by a chained hash of its turns. Nodes along which no conversation ends or
branches off form one segment; each segment is emitted once, in depth-first order, as one interval of a common token
sequence, with the position id of its first token (the tokens before it in its conversations) and the intervals it may
attend to: its ancestors and itself, causally.

Turns of a conversation are chained in a stream over sorted partitions; a first turn shared by a third of all
conversations is counted with map-side combine, and joins against it are split by adaptive execution. Depth-first order
is the order of paths, found by range partitioning, so no tree is held by one task.

Defined results: null texts and roles are empty; a missing role is the empty role. Turns go by turn, then role, then
text (null turns first); repeated rows are repeated turns. Empty tables give empty trees. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventwarden.llm.jobs import INT, LONG, STRING, field, prepared, staged

# fixed values: the template
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s>", "</s>")
SYSTEM = ("<<SYS>>", "<</SYS>>")
ROLE = ("<<ROLE>>", "<</ROLE>>")
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """No control string survives: each gets a backslash after its first character; backslashes are doubled."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and where its loss span begins and ends; an empty span without loss."""
    body = escaped(text)
    if role == "user":
        return USER[0] + body + USER[1], 0, 0
    if role == "assistant":
        return ASSISTANT[0] + body + ASSISTANT[1], len(ASSISTANT[0]), len(ASSISTANT[0]) + len(body)
    if role == "system":
        return SYSTEM[0] + body + SYSTEM[1], 0, 0
    return ROLE[0] + escaped(role) + ROLE[1] + body + ASSISTANT[1], 0, 0


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        role = None
        if text.startswith(ROLE[0], at):
            end = text.index(ROLE[1], at)
            role = unescaped(text[at + len(ROLE[0]):end])
            start, closing = end + len(ROLE[1]), ASSISTANT[1]
        else:
            role, (opening, closing) = next((r, m) for r, m in (("user", USER), ("assistant", ASSISTANT), ("system", SYSTEM))
                                            if text.startswith(m[0], at))
            start = at + len(opening)
        end = text.index(closing, start)
        turns.append((role, unescaped(text[start:end])))
        at = end + len(closing)
    return turns


def _chained(before: str, role: str, text: str) -> str:
    part = f"{before}\n{len(role)}\n{role}\n{text}"
    return hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


TURN = T.StructType([field("depth", INT), field("node", STRING), field("piece", STRING), field("loss_start", INT),
                     field("loss_end", INT)])


def _nodes(conversations: DataFrame) -> DataFrame:
    """Per turn: its depth, the hash of the conversation up to it, and its formatted text."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["conv_id"], *TURN.fields])

    def run(batches):
        conv, depth, node = object(), 0, ""
        for batch in batches:
            ids = batch.column(0)
            out: list[list] = [[] for _ in TURN.fields]
            for key, role, text in zip(ids.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != conv:
                    conv, depth, node = key, 0, ""
                node = _chained(node, role, text)
                piece, start, end = formatted(role, text)
                for column, value in zip(out, (depth, node, piece, start, end)):
                    column.append(value)
                depth += 1
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32())], names=schema.names)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)


LOSS = T.ArrayType(T.ArrayType(T.IntegerType()))
SEGMENT = T.StructType([field("segment", STRING), field("parent", STRING), field("path", STRING), field("level", INT),
                        field("position", LONG), field("n_tokens", LONG), field("last", INT), field("text", STRING),
                        field("loss", LOSS)])


def _segments(turns: DataFrame) -> DataFrame:
    """Runs of a conversation's nodes that the same conversations share; the text only in one of those."""
    schema = T.StructType([turns.schema["conv_id"], *SEGMENT.fields])

    def told(conv, run_) -> tuple:
        text = "".join(run_["pieces"]) if run_["own"] else None
        return (conv, run_["name"], run_["parent"], run_["path"], run_["level"], run_["position"], run_["n"], 0, text,
                run_["loss"] if run_["own"] else None)

    def rows_of(batches) -> Iterator[pa.RecordBatch]:
        id_type, conv, open_run, out = None, object(), None, []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            names = ("conv_id", "node", "piece", "loss_start", "loss_end", "shared", "owner")
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for key, node, piece, start, end, shared, owner in zip(*columns):
                same = key == conv and open_run is not None
                if not same or shared != open_run["shared"]:
                    if open_run is not None:
                        out.append(told(conv, open_run))
                        if not same:
                            out[-1] = (*out[-1][:7], 1, *out[-1][8:])
                    before = open_run if same else None
                    open_run = {
                        "name": node, "parent": before["name"] if before else None,
                        "path": (before["path"] if before else "") + node, "level": before["level"] + 1 if before else 0,
                        "position": before["position"] + before["n"] if before else 0, "n": 0, "shared": shared,
                        "own": owner == key, "pieces": [], "loss": []}
                    conv = key
                if end > start or piece.startswith(ASSISTANT[0]):
                    open_run["loss"].append([open_run["n"] + start, open_run["n"] + end])
                if open_run["own"]:
                    open_run["pieces"].append(piece)
                open_run["n"] += len(piece)
            yield batch_of(out, id_type)
            out = []
        if open_run is not None:
            last = told(conv, open_run)
            yield batch_of([(*last[:7], 1, *last[8:])], id_type)

    def batch_of(out, id_type):
        types = [id_type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(),
                 pa.list_(pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                          names=schema.names)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(rows_of, schema)


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree's segments, and per conversation the segment it ends in.

    Segments: ``segment``, ``parent``, ``level``, ``start`` and ``end`` in the common token sequence, ``position`` of
    the first token, ``text``, ``loss`` (spans in the text), ``attends`` (intervals of ancestors, outermost first).
    Leaves: ``conv_id``, ``segment``.
    """
    prepared(conversations.sparkSession)
    turns = staged(_nodes(conversations), "turns")
    shared = turns.groupBy("node").agg(F.count("*").alias("shared"), F.min("conv_id").alias("owner"))
    runs = staged(_segments(turns.join(shared, "node")), "runs")
    # one conversation owns each segment; its row alone has the text, which joins again when all places are known
    own = runs.filter("text is not null")
    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # depth-first order is path order: a path begins with its ancestors' paths
    dealt = staged(
        own.select("segment", "parent", "path", "level", "position", "n_tokens").repartitionByRange(width, "path")
        .withColumn("slice", F.spark_partition_id()), "segments")
    sums = dealt.groupBy("slice").agg(F.sum("n_tokens").alias("held"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    base = sums.select("slice", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("slice").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    placed = staged(
        dealt.withColumn("end", F.sum("n_tokens").over(within)).join(F.broadcast(base), "slice")
        .withColumn("end", F.col("end") + F.col("base")).withColumn("start", F.col("end") - F.col("n_tokens")), "placed")
    names = placed.select("segment", "path", "level", F.explode(
        F.expr("transform(sequence(0, level), i -> substring(path, 32 * i + 1, 32))")).alias("ancestor"))
    spans = placed.select(F.col("segment").alias("ancestor"), F.struct("start", "end").alias("span"))
    attends = names.join(spans, "ancestor").groupBy("segment").agg(F.array_sort(F.collect_list("span")).alias("attends"))
    tree = staged(placed.join(attends, "segment").join(own.select("segment", "text", "loss"), "segment").select(
        "segment", "parent", "level", "start", "end", "position", "text", "loss", "attends"), "tree")
    return tree, runs.filter("last = 1").select("conv_id", "segment")


def read_back(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per conversation, from the emitted tree alone: its formatted text and loss spans, outermost segment first."""
    wanted = leaves.join(tree.select("segment", "attends"), "segment").select("conv_id", F.explode("attends").alias("span"))
    held = tree.select(F.col("start").alias("at"), "text", "loss")
    pieces = wanted.select("conv_id", F.col("span.start").alias("at")).join(held, "at")
    return pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "text", "loss"))).alias("pieces"))


DIGESTS = T.StructType([field("n_turns", LONG), field("turns_sha256", STRING), field("loss_chars", LONG),
                        field("loss_sha256", STRING), field("formatted_chars", LONG)])


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text and loss mask say when read back."""
    read = read_back(*prefix_tree(conversations))
    schema = T.StructType([read.schema["conv_id"], *DIGESTS.fields])

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in DIGESTS.fields]
            for pieces in batch.column(1).to_pylist():
                text = "".join(p["text"] for p in pieces)
                turns = parsed(text)
                loss = "".join(unescaped(p["text"][s:e]) for p in pieces for s, e in p["loss"])
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                values = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss),
                          hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string() if f.dataType == STRING else pa.int64())
                                    for c, f in zip(out, DIGESTS.fields))], names=schema.names)

    return read.mapInArrow(run, schema)
