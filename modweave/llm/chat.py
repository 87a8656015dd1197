"""Chat formatting: reply trees, their best root-to-leaf paths, and a template that can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm.common import cut, inline, table

TAUGHT = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|:|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """``### role: text</turn>`` line by line, and the spans (in code points) that are trained on.

    A backslash goes before every backslash and before control strings inside roles and texts.
    """
    out, mask, at = [], [], 0
    for role, text in turns:
        head = "### " + _ROLE_CONTROL.sub(r"\\\g<0>", role) + ": "
        body = _CONTROL.sub(r"\\\g<0>", text)
        if role == TAUGHT:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), mask


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((plain(m[1]), plain(m[2])))
        at = m.end()
    return out


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """``tree, leaf, rank, depth, node``: the nodes of each chosen root-to-leaf path, depth 0 at the leaf.

    ``nodes(tree, node, parent, score)``: a null or absent parent makes a root. Self-joins double the reach of
    each node's ancestor pointer and of its score sum, so a path of n nodes takes log2(n) rounds. Branches are
    ranked in their tree by mean score, then leaf id; ``top`` keeps the best so many (None: all). Only chosen
    leaves are then expanded, again by doubling. Nodes of a reply cycle have no root and are on no path.
    """
    nodes = nodes.select("tree", "node", "parent", "score")  # extra columns, of any name, are not read
    known = nodes.select(F.col("tree").alias("t_"), F.col("node").alias("n_")).distinct()
    base = nodes.join(known, nodes["tree"].eqNullSafe(F.col("t_")) & (nodes["parent"] == F.col("n_")), "left")
    base = cut(base.select("tree", "node", F.col("n_").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"), F.lit(1).cast("long").alias("len")))
    largest = base.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, at = [], base
    while True:
        hop = at.where("up is not null")
        if (1 << len(jumps)) > largest or hop.isEmpty():
            break
        jumps.append(hop.select(F.col("tree").alias("t_"), F.col("node").alias("n_"), F.col("up").alias("u_")))
        over = at.select(F.col("tree").alias("t_"), F.col("node").alias("n_"), F.col("up").alias("u_"), F.col("sum").alias("s_"), F.col("len").alias("l_"))
        at = at.join(over, at["tree"].eqNullSafe(F.col("t_")) & (F.col("up") == F.col("n_")), "left")
        at = cut(at.select("tree", "node", F.col("u_").alias("up"), (F.col("sum") + F.coalesce("s_", F.lit(0.0))).alias("sum"), (F.col("len") + F.coalesce("l_", F.lit(0))).alias("len")))
    parents = base.select(F.col("tree").alias("t_"), F.col("up").alias("u_")).where("u_ is not null").distinct()
    leaves = at.where("up is null").join(parents, at["tree"].eqNullSafe(F.col("t_")) & (F.col("node") == F.col("u_")), "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("len")).desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if top is not None:
        leaves = leaves.where(F.col("rank") <= top)
    path = leaves.select("tree", F.col("node").alias("leaf"), "rank", F.lit(0).cast("long").alias("depth"), "node")
    for k, jump in enumerate(jumps):
        here, there = F.struct("depth", "node"), F.struct((F.col("depth") + (1 << k)).alias("depth"), F.col("u_").alias("node"))
        path = path.join(jump, path["tree"].eqNullSafe(F.col("t_")) & (F.col("node") == F.col("n_")), "left")
        path = path.select("tree", "leaf", "rank", F.inline(F.filter(F.array(here, there), lambda x: x["node"].isNotNull())))
        path = cut(path) if k % 3 == 2 else path
    return path


def threads(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as reply trees: each row answers the one before it by turn.

    Ties and null turns are put in order by role and text; nulls come first. Repeated rows are turns of their own.
    Null roles and texts are empty; a null id is a conversation. An empty table gives none; extra columns are not read.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("node"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length("text").cast("double"))


def formatted(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """``conv_id, leaf, rank, formatted, mask`` of the best ``top`` paths of each tree of ``nodes``.

    ``nodes(conv_id, node, parent, role, text, score)``. One conversation is one string, so one must fit a row;
    nothing larger is collected. A null score counts 0. An empty table gives an empty result; extra columns, of any
    name, are not read.
    """
    path = branches(nodes.select(F.col("conv_id").alias("tree"), "node", "parent", "score"), top)
    said = nodes.select(F.col("conv_id").alias("c_"), F.col("node").alias("m_"), "role", "text")
    full = path.join(said, F.col("tree").eqNullSafe(F.col("c_")) & (F.col("node") == F.col("m_")))
    turn = F.struct((-F.col("depth")).alias("at"), "role", "text")
    full = full.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            mask = pa.array([[{"start": x, "end": y} for x, y in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("leaf"), b.column("rank"), pa.array([f for f, _ in made], pa.string()), mask], ["conv_id", "leaf", "rank", "formatted", "mask"])

    return full.select("tree", "leaf", "rank", "turns").mapInArrow(rendered, "conv_id long, leaf long, rank int, formatted string, mask array<struct<start: long, end: long>>")


def digests(made: DataFrame) -> DataFrame:
    """What is read back from the formatted strings and their masks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, text, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask"))):
                turns = read_back(text)
                loss = plain("".join(text[m["start"] : m["end"]] for m in mask))
                rows.append((conv, len(turns), sha(x for r, t in turns for x in (r, "\n", t, "\n")), len(loss), sha([loss]), len(text)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    own = inline(spark, [{"conv_id": -7, "turn": i, "role": r, "text": hard} for i, r in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return digests(formatted(threads(rows)))
