"""Chat formatting over reply trees.

Turns are nodes with a parent. Iterative self-joins double each node's pointer to an ancestor, so a path of n turns takes
log2(n) joins; they give every node its root, depth and summed score. Branches are the root-to-leaf paths; those of a
tree are ranked by mean score, and the best one (of equals the longest, then the one whose leaf comes first) is expanded
through the same pointers and formatted.

The template: ``<s>`` opens a conversation; ``[INST] text [/INST]`` is a user turn, ``text</s>`` an assistant turn and
``[ROLE]name[/ROLE]text</s>`` any other. Inside texts a backslash is doubled and one is put after the first character of
anything that reads like a control string, so no text contains one, and reading back restores each text.

Nulls, ties and odd rows: a null text is empty, a null role is kept as such, a null conversation id is one conversation.
Rows that tie in turn are ordered by role and text. A parent that does not exist makes its child a root; nodes on a
cycle have no root and are left out. A tree with several roots gives a conversation per root. A text of any length is formatted
whole; a conversation is one row, so it has to fit in one. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value, stored

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of it that count for the loss: the assistant's texts."""
    parts, at, loss = ["<s>"], 3, []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            before, after = "[INST] ", " [/INST]"
        else:
            name = "\\N" if role is None else escape(role)
            before, after = "" if role == "assistant" else f"[ROLE]{name}[/ROLE]", "</s>"
        if role == "assistant":
            loss.append((at, at + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), loss


def parse_turns(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at + 6)
            turns.append(("user", unescape(formatted[at + 7 : end])))
            at = end + 8
            continue
        role: str | None = "assistant"
        if formatted.startswith("[ROLE]", at):
            end = formatted.index("[/ROLE]", at)
            name = formatted[at + 6 : end]
            role, at = None if name == "\\N" else unescape(name), end + 7
        end = formatted.index("</s>", at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + 4
    return turns


def linear_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of plain conversations, each turn answering the one before."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, role_col, text_col)
    node = F.row_number().over(order).cast("long")
    return turns.select(F.col(conv_col).alias("conv_id"), node.alias("node"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("*", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))


def chosen_paths(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """key, root, depth and node of the best branch of every root, for nodes (key, node, parent, score)."""
    known = nodes.select("key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = nodes.join(known, ["key", "parent"], "left").select("key", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    base = stored(base, "replies")
    # up: the ancestor 2^k turns above; steps and total: turns and score from the node to just below it; top: the last node so far
    state = base.select("key", "node", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"), F.col("node").alias("top"))
    ended, active = [state.where("up is null")], state.where("up is not null")
    jumps = [active.select("key", "node", "up")]
    for _ in range(min(max(1, base.count().bit_length()), max_rounds)):
        if active.isEmpty():
            break
        # only nodes that have not reached their root go on
        above = reduce(DataFrame.unionByName, ended, active).select("key", F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("total").alias("gain"), F.col("top").alias("above"))
        moved = active.join(above, ["key", "up"]).select("key", "node", F.col("far").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("gain")).alias("total"), F.col("above").alias("top"))
        moved = stored(moved, "pointers")
        ended, active = [*ended, moved.where("up is null")], moved.where("up is not null")
        jumps.append(active.select("key", "node", "up"))
    parents = base.where("up is not null").select("key", F.col("up").alias("node")).distinct()
    leaves = reduce(DataFrame.unionByName, ended).join(parents, ["key", "node"], "left_anti")
    best = leaves.groupBy("key", F.col("top").alias("root")).agg(F.max(F.struct(F.col("total") / F.col("steps"), "steps", (-F.col("node")).alias("node"))).alias("best"))
    pieces = [stored(best.select("key", "root", (-F.col("best.node")).alias("node"), F.col("best.steps").alias("depth")), "leaves")]
    for k in range(len(jumps) - 1, -1, -1):
        found = reduce(DataFrame.unionByName, pieces)
        pieces.append(stored(found.join(jumps[k], ["key", "node"]).select("key", "root", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")), "paths"))
    return reduce(DataFrame.unionByName, pieces)


def _key(column: str):
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation, root and depth."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def rows(done: list[tuple]) -> pa.RecordBatch:
        texts = [format_turns(t) for _, _, t in done]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in done], pa.int64()), pa.array([r for _, r, _ in done], pa.int64()), pa.array([t for t, _ in texts], pa.string()), pa.array([[{"start": a, "stop": z} for a, z in loss] for _, loss in texts], spans)],
            names=["conv_id", "root", "formatted", "loss"],
        )

    current, turns = None, []
    for batch in batches:
        done = []
        for conv_id, root, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "root", "role", "text")), strict=True):
            if current is not None and (conv_id, root) != current:
                done.append((*current, turns))
                turns = []
            current = (conv_id, root)
            turns.append((role, text))
        yield rows(done)
    if current is not None:
        yield rows([(*current, turns)])


def format_trees(nodes: DataFrame) -> DataFrame:
    """conv_id, root, formatted and loss (spans of formatted) of the best branch of every root; nodes have conv_id, node, parent, role, text and score."""
    keyed = nodes.withColumn("key", _key("conv_id"))
    paths = chosen_paths(keyed.select("key", "node", "parent", "score"))
    turns = keyed.select("key", "conv_id", "node", "role", "text").join(paths, ["key", "node"])
    turns = turns.repartition("key").sortWithinPartitions("key", "root", "depth").select(F.col("conv_id").cast("long"), "root", "role", "text")
    return turns.mapInArrow(_format, "conv_id long, root long, formatted string, loss array<struct<start:long,stop:long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse_turns(text)
            learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
            said = hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], names=["conv_id", *kinds])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, from parsing them again."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ship_by_value(__name__)
