"""Chat formatting into a prefix tree: shared turns once, depth-first, with positions and attention intervals.

Every turn is formatted as `<s>[role]text</s>`; a backslash is put before each `\\`, `<`, `[` and `]` of a role or text, so no control
string can stand inside one, and taking the backslashes away gives the original back.

A conversation is the path of its turns in a tree, a node being a turn after all turns before it (a chained
128-bit digest). Sorted by path, conversations come depth-first, and each one adds the nodes that
it does not share with its predecessor. The packed stream holds every node once, with its offset, the position of its
first character in its conversations (characters are the unit, as they are for any tokenizer that is applied to
the pieces), the span under the loss mask, and the intervals of its ancestors, which are what it may attend to besides itself.

Sorting is by (path, id) over ranges, so a first turn, or a whole conversation, that a third of all have in common is
spread over tasks. Two paths per range reach the driver.

Defined results: null texts and roles count as empty; turns go by number, then role and text, null numbers first;
repeated rows are repeated turns; rows with null id are one conversation. Other columns are not read. An empty table
gives empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakestrata.llm.common import new_folder, stored, whole_text

TRAINED_ROLE = "assistant"
SPECIAL = re.compile(r"([\\<\[\]])")
TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]((?:[^\\<]|\\.)*)</s>", re.S)
PATH_BYTES = 16


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"<s>[{escape(role)}]", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def shared_depth(a: bytes, b: bytes) -> int:
    """How many leading nodes two paths have in common."""
    low, high = 0, min(len(a), len(b)) // PATH_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * PATH_BYTES] == b[: middle * PATH_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and path (the digests of its nodes in a row) of each conversation, with its turns."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column(1).to_pylist():
                node, path = b"", []
                for turn in own:
                    said = format_turn(turn["role"], turn["text"])[0]
                    node = hashlib.sha256(node + said.encode("utf-8", "surrogatepass")).digest()[:PATH_BYTES]
                    path.append(node)
                found.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["conv_id", "turns", "path"])

    schema = whole.select("*", F.lit(b"").alias("path")).schema
    return whole.mapInArrow(run, schema)


def in_order(whole: DataFrame) -> DataFrame:
    """The conversations depth-first: with the range `part` and the place `at` in it, and how many nodes are `old`."""
    kind = whole.schema["conv_id"].dataType.simpleString()
    turns = whole.schema["turns"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            own = batch.column(2).to_pylist()
            old = []
            for path in own:
                old.append(0 if before is None else shared_depth(before, path))
                before = path
            places = list(range(at, at + len(own)))
            at += len(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(places, pa.int64()), pa.array(old, pa.int32())],
                ["conv_id", "turns", "path", "part", "at", "old"],
            )

    spark = whole.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = stored(
        dealt.mapInArrow(run, f"conv_id {kind}, turns {turns}, path binary, part int, at long, old int"), new_folder(spark, "chat-order")
    )
    ends = ordered.groupBy("part").agg(F.min_by("path", "at").alias("first"), F.max_by("path", "at").alias("last"))
    rows = sorted(ends.collect(), key=lambda row: row.part)  # two paths per range
    joints = [(b.part, shared_depth(bytes(a.last), bytes(b.first))) for a, b in zip(rows, rows[1:])]
    seams = F.broadcast(spark.createDataFrame(joints, "part int, joint int"))
    return ordered.join(seams, "part", "left").withColumn(
        "old", F.when((F.col("at") == 0) & F.col("joint").isNotNull(), F.col("joint")).otherwise(F.col("old"))
    ).drop("joint")


def chat_tree(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> tuple[DataFrame, DataFrame]:
    """The packed stream and the conversations in it.

    Stream: offset, length, position, depth, text, loss_begin, loss_end (within the text; equal where nothing is
    trained on), ancestors (intervals [begin, end) of offsets). Conversations: conv_id, intervals (of its nodes, in order).
    """
    spark = conversations.sparkSession
    turns = conversations.select("conv_id", "turn", whole_text("role").alias("role"), whole_text("text").alias("text"))
    ordered = in_order(paths(turns))
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "at", "depth", "node", "new", "length", "position", "text", "loss_begin", "loss_end"]
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for row in batch.to_pylist():
                position = 0
                for depth, turn in enumerate(row["turns"]):
                    said, begin, end = format_turn(turn["role"], turn["text"])
                    new = depth >= row["old"]
                    node = row["path"][depth * PATH_BYTES : (depth + 1) * PATH_BYTES]
                    trained = turn["role"] == trained_role
                    values = (
                        row["conv_id"], row["part"], row["at"], depth, node, new, len(said), position,
                        said if new else None, begin if trained else 0, end if trained else 0,
                    )
                    for name, value in zip(names, values):
                        out[name].append(value)
                    position += len(said)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in pa.schema(fields(batch))], names)

    def fields(batch: pa.RecordBatch) -> list[pa.Field]:
        long, whole, text = pa.int64(), pa.int32(), pa.string()
        return [
            pa.field("conv_id", batch.schema.field("conv_id").type), pa.field("part", whole), pa.field("at", long),
            pa.field("depth", whole), pa.field("node", pa.binary()), pa.field("new", pa.bool_()), pa.field("length", long),
            pa.field("position", long), pa.field("text", text), pa.field("loss_begin", long), pa.field("loss_end", long),
        ]

    steps = stored(
        ordered.mapInArrow(
            nodes,
            f"conv_id {kind}, part int, at long, depth int, node binary, new boolean, length long, position long, "
            "text string, loss_begin long, loss_end long",
        ),
        new_folder(spark, "chat-steps"),
    )
    sizes = steps.filter("new").groupBy("part").agg(F.sum("length").alias("size")).collect()  # a number per range
    bases, total = [], 0
    for row in sorted(sizes, key=lambda row: row.part):
        bases.append((row.part, total))
        total += row["size"]
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    # the range's own running offset; a range is one task's share of the sorted conversations
    running = Window.partitionBy("part").orderBy("at", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        steps.filter("new")
        .join(base, "part")
        .withColumn("offset", F.col("base") + F.coalesce(F.sum("length").over(running), F.lit(0)))
    )
    offsets = placed.select("node", "offset")
    met = steps.select("conv_id", "part", "at", "depth", "node", "new", "length").join(offsets, "node")
    interval = F.struct(F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"))
    whole = met.groupBy("part", "at").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", interval.alias("span")))).alias("found")
    )
    spans = F.transform("found", lambda x: x["span"])
    whole = stored(whole.select("part", "at", "conv_id", spans.alias("intervals")), new_folder(spark, "chat-spans"))
    stream = placed.join(whole.select("part", "at", "intervals"), ["part", "at"]).select(
        "offset", "length", "position", "depth", "text", "loss_begin", "loss_end",
        F.slice("intervals", F.lit(1), F.col("depth")).alias("ancestors"),
    )
    return stored(stream, new_folder(spark, "chat-stream")), whole.select("conv_id", "intervals")


def read_back(stream: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, formatted text and the pieces of text under the loss mask, read from the packed stream."""
    wanted = conversations.withColumn("row", F.monotonically_increasing_id())
    wanted = wanted.select("conv_id", "row", F.posexplode("intervals").alias("k", "span")).select("conv_id", "row", "k", F.col("span.begin").alias("offset"))
    trained = F.when(
        F.col("loss_end") > F.col("loss_begin"),
        F.substring("text", (F.col("loss_begin") + 1).cast("int"), (F.col("loss_end") - F.col("loss_begin")).cast("int")),
    )
    pieces = wanted.join(stream.select("offset", "text", trained.alias("trained")), "offset")
    whole = pieces.groupBy("row").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("k", "text", "trained"))).alias("found")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("found", lambda x: x["text"]), "").alias("formatted"),
        F.array_compact(F.transform("found", lambda x: x["trained"])).alias("trained"),
    )


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of conversations that were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, trained in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(map(unescape, trained))
                rows.append(
                    {
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(formatted),
                    }
                )
            kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
            arrays = [pa.array([row[name] for row in rows], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", *kinds])

    kind = read.schema["conv_id"].dataType.simpleString()
    return read.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
