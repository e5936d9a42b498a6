"""Chat formatting as a prefix tree: turns that conversations share from their start on are emitted once.

A turn is a node, known by the digest of all turns up to it. Nodes are emitted depth-first as one stream of tokens;
each has position ids that continue those of its ancestors, and the stream intervals of its ancestors, which its tokens
may attend to. Conversations point at their last node.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

#: The template: "### role:\n", the text, "\n</turn>\n". Control strings inside roles and texts are escaped.
HEAD, COLON, TAIL = "### ", ":\n", "\n</turn>\n"
ESCAPES = {"\\": "\\\\", "###": "##\\h", "</turn>": "\\l/turn>"}
ROLE_ESCAPES = {**ESCAPES, ":": "\\c", "\n": "\\n"}
UNESCAPES = {"\\": "\\", "h": "#", "l": "<", "c": ":", "n": "\n"}
TRAINED_ROLE = "assistant"


def escape(text: str, table: dict[str, str] = ESCAPES) -> str:
    return re.sub("|".join(map(re.escape, table)), lambda m: table[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: UNESCAPES[m[1]], text)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, _, rest = turn.removeprefix(HEAD).partition(COLON)
    return unescape(role), unescape(rest.removesuffix(TAIL))


@dataclass
class ChatTree:
    """nodes: node, tree, parent, depth, ids, loss_from, loss_to (token numbers in ids), start (in the stream), position (of
    its first token), ancestors (array of stream intervals [from, to)). leaves: leaf, path (its nodes, root first).
    conversations: conv_id, leaf, n_turns."""

    nodes: DataFrame
    leaves: DataFrame
    conversations: DataFrame


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # their strings inside a text are ordinary text
    return out


def _running_start(nodes: DataFrame) -> DataFrame:
    """nodes in stream order with start: token counts before each, summed per sorted partition and over partitions."""
    ordered = materialize(nodes.orderBy("owner", "depth").withColumn("o", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("pid", F.shiftright("o", 33))
    parts = ordered.groupBy("pid").agg(F.sum("n").alias("s"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "pid")
    return out.withColumn("start", F.col("base") + F.col("inside")).drop("pid", "base", "inside", "o")


def chat_tree(rows: DataFrame, tokenizer_path: str) -> ChatTree:
    """The tree of rows(conv_id, turn, role, text); other columns are not read.

    Turns stand in the order of turn (null first), ties by role and text; each row is a turn, also where rows repeat.
    Null roles and texts are empty ones; rows without conv_id form one conversation. No rows make an empty tree.
    """

    @F.pandas_udf("array<string>")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def chain(turns) -> list[str]:
            out, last = [], ""
            for t in turns:
                last = hashlib.md5("\x00".join((last, str(len(t["role"])), t["role"], t["text"])).encode("utf-8", "surrogatepass")).hexdigest()
                out.append(last)
            return out

        for batch in batches:
            yield batch.map(chain)

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    slim = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chained = materialize(grouped.select("conv_id", slim.alias("turns")).withColumn("path", digests("turns")))
    conversations = chained.select("conv_id", F.element_at("path", -1).alias("leaf"), F.size("path").cast("long").alias("n_turns"))

    # Different paths only: however many conversations are equal, their path is sorted once. The sort is depth-first order.
    paths = chained.select(F.element_at("path", -1).alias("leaf"), "path").groupBy("leaf").agg(F.first("path").alias("path"))
    leaves = materialize(paths.orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    steps = leaves.select("rank", "leaf", F.posexplode("path").alias("depth", "node"), "path")
    steps = steps.withColumns({"parent": F.when(F.col("depth") > 0, F.element_at("path", F.col("depth"))), "tree": F.element_at("path", 1)})
    shape = steps.groupBy("node", "depth", "parent", "tree").agg(F.min("rank").alias("owner"))
    said = chained.select(F.inline(F.arrays_zip("path", "turns"))).select(F.col("path").alias("node"), "turns.role", "turns.text")
    said = said.groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))

    @F.pandas_udf("ids array<int>, loss_from int, loss_to int")
    def tokens(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_path)
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        for roles, texts in batches:
            heads = encode([HEAD + escape(r, ROLE_ESCAPES) + COLON for r in roles])
            bodies = encode([escape(t) for t in texts])
            tail = encode([TAIL])[0]
            spans = [(len(h), len(h) + len(b)) if r == TRAINED_ROLE else (0, 0) for r, h, b in zip(roles, heads, bodies)]
            yield pd.DataFrame({"ids": [h + b + tail for h, b in zip(heads, bodies)], "loss_from": [a for a, _ in spans], "loss_to": [b for _, b in spans]})

    texts = said.withColumn("x", tokens("role", "text")).select("node", "x.ids", "x.loss_from", "x.loss_to", F.size("x.ids").alias("n"))
    placed = materialize(_running_start(shape.join(texts, "node")))

    @F.pandas_udf("array<struct<position:long, ancestors:array<struct<from:long, to:long>>>>")
    def ancestry(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def along(path) -> list[dict]:
            out, position, spans = [], 0, []
            for step in path:
                out.append({"position": position, "ancestors": [{"from": a, "to": b} for a, b in spans]})
                if spans and spans[-1][1] == step["start"]:
                    spans[-1] = (spans[-1][0], step["start"] + step["n"])
                else:
                    spans.append((step["start"], step["start"] + step["n"]))
                position += step["n"]
            return out

        for batch in batches:
            yield batch.map(along)

    # Each leaf's path with the places of its nodes; a leaf then describes the nodes that it owns.
    place = F.struct("depth", "start", "n", "node", "owner")
    whole = steps.select("rank", "node").join(placed.select("node", place.alias("p")), "node").groupBy("rank").agg(F.sort_array(F.collect_list("p")).alias("p"))
    whole = whole.withColumn("a", ancestry(F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["n"].cast("long").alias("n")))))
    own = whole.select("rank", F.inline(F.arrays_zip("p", "a"))).filter(F.col("p.owner") == F.col("rank"))
    own = own.select("p.node", "a.position", "a.ancestors")
    return ChatTree(placed.join(own, "node").drop("owner", "n"), leaves.select("leaf", "path"), conversations)


def read_back(tree: ChatTree, tokenizer_path: str) -> DataFrame:
    """Per conversation what its tokens say: conv_id, n_turns, formatted, turns (role, text), loss (texts under the mask)."""

    @F.pandas_udf("formatted string, role string, text string, loss string")
    def decoded(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(tokenizer_path)
        for ids, starts, ends in batches:
            full = tokenizer.decode_batch([list(i) for i in ids], skip_special_tokens=False)
            loss = tokenizer.decode_batch([list(i[a:b]) for i, a, b in zip(ids, starts, ends)], skip_special_tokens=False)
            said = [parse(t) for t in full]
            yield pd.DataFrame({"formatted": full, "role": [r for r, _ in said], "text": [t for _, t in said], "loss": [unescape(x) for x in loss]})

    nodes = tree.nodes.select("node", decoded("ids", "loss_from", "loss_to").alias("x"))
    steps = tree.leaves.select("leaf", F.posexplode("path").alias("depth", "node"))
    by_leaf = steps.join(nodes, "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "x"))).alias("s"))
    pick = lambda c: F.transform("s", lambda t: t["x"][c])
    turns = F.transform("s", lambda t: F.struct(t["x"]["role"].alias("role"), t["x"]["text"].alias("text")))
    said = materialize(by_leaf.select("leaf", F.array_join(pick("formatted"), "").alias("formatted"), turns.alias("turns"), F.array_join(pick("loss"), "").alias("loss")))
    return tree.conversations.join(said, "leaf").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "turns", "loss")
