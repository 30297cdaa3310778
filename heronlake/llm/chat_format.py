"""Chat formatting of reply trees.

Messages form trees (each names its parent). Iterative self-joins double the reach of each message's
link to its ancestors: after k joins a link spans 2**k messages, so a path of length L needs log2(L) joins,
not L. The links are then applied from the widest to the narrowest to list each leaf's ancestors once. Branches
are ranked by the sum of their messages' scores, the chosen ones gather their texts, and each becomes one
conversation.

Template. A turn is `<s>[ROLE] role [/ROLE] text</s>`, turns in a row with nothing between. A control string inside
a role or text gets a backslash after its first character (one more if backslashes stand there), so that
no control string is left in it, and reading back takes one away. The loss mask covers the assistant's texts as
they stand in the output (without their end marks).

Cases: null or empty text is an empty turn; null role is the empty role; equal scores rank by leaf id; messages
that repeat an id count once (smallest role and text); messages whose parent is absent are roots; messages in a cycle, or below
one, have no root and give no path; an empty table gives an empty result; other columns are ignored. A conversation is one
row of the result, so one row's memory follows its own length.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import Written, table

CONTROL = r"(?:/?s>|/?ROLE\]|/?INST\])"
_ESCAPE = re.compile(rf"([<\[])(\\*{CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*{CONTROL})")
_TURN = re.compile(r"<s>\[ROLE\] (.*?) \[/ROLE\] (.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the spans (code points) under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[ROLE] {escape(role)} [/ROLE] ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not in the template at character {at}")
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """Written (leaf, node, up) for each leaf under a root: the node that is `up` messages above the leaf, 0 the leaf itself.

    nodes: node, parent (unique node ids). Every self-join is an equi-join on node ids with one row on one side.
    """
    known = nodes.select(F.col("node").alias("parent"))
    link = Written(nodes.join(known, "parent", "left_semi").select("node", F.col("parent").alias("above")), "links")
    links = [link]
    endless = None  # nodes without a root above them
    while not links[-1].df.isEmpty():
        if len(links) > 40:
            raise ValueError("messages form a cycle")  # 2**40 messages above one another
        one = links[-1].df
        two = one.select(F.col("node").alias("above"), F.col("above").alias("top"))
        links.append(Written(one.join(two, "above").select("node", F.col("top").alias("above")), "links"))
        if len(links) > 2 and _same_size(links):
            endless = links.pop().df.select("node")  # no further node has ended: those left lie on a cycle or below one
            break
    leaves = nodes.select("node").join(link.df.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, "node", "left_anti")
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(links) - 1, -1, -1):
        wider = found.join(links[k].df, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))
        found = Written(found.unionByName(wider), "paths").df
    return found


def _same_size(links: list[Written]) -> bool:
    return links[-1].df.count() == links[-2].df.count()


def branches(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, rank, turns) of each tree's best branches (all where per_tree is None).

    messages: tree, node, parent, role, text, score.
    """
    once = messages.groupBy("node").agg(F.min(F.struct("tree", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("node", "m.*")
    nodes = Written(once, "messages")
    on = paths(nodes.df.select("node", "parent"))
    scored = on.join(nodes.df.select("node", "tree", "score"), "node").groupBy("leaf").agg(F.sum("score").alias("total"), F.min("tree").alias("tree"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    best = scored.select("tree", "leaf", rank.alias("rank"))
    if per_tree is not None:
        best = best.where(F.col("rank") <= per_tree)
    texts = on.join(nodes.df.select("node", "role", "text"), "node").select("leaf", F.struct((-F.col("up")).alias("at"), "role", "text").alias("turn"))
    return best.join(texts.groupBy("leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "leaf")


def _format(turns: pd.Series) -> pd.DataFrame:
    out = [render([(t["role"], t["text"]) for t in x]) for x in turns]
    return pd.DataFrame({"formatted": [f for f, _ in out], "mask": [[{"start": a, "stop": b} for a, b in m] for _, m in out]})


def format_branches(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, mask): one conversation for each chosen branch."""
    to_text = F.pandas_udf(_format, "formatted string, mask array<struct<start:long,stop:long>>")
    return branches(messages, per_tree).withColumn("c", to_text("turns")).select("tree", "leaf", "rank", "c.formatted", "c.mask")


def _read_back(formatted: pd.Series, mask: pd.Series) -> pd.DataFrame:
    rows = []
    for f, m in zip(formatted, mask, strict=True):
        turns = parse(f)
        loss = "".join(unescape(f[x["start"] : x["stop"]]) for x in m)
        rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(f)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the turn before it.

    Rows of one turn keep all their copies, in the order of role and text. A conversation is a tree of one branch.
    """
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = conversations.select(F.coalesce("conv_id", F.lit(None).cast("long")).alias("conv_id"), "turn", "role", "text").withColumn("at", F.row_number().over(at))
    node = lambda i: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), i.cast("string"))
    return place.select(F.col("conv_id").alias("tree"), node(F.col("at")).alias("node"), F.when(F.col("at") > 1, node(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


#: A conversation whose texts hold control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    done = format_branches(chain(given.unionByName(extra)))
    digests = F.pandas_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return done.withColumn("d", digests("formatted", "mask")).select(F.col("tree").alias("conv_id"), "d.*")
