"""Chat formatting of reply trees. DataFrame operations only.

Messages name their parent. Self-joins with ancestors 1, 2, 4, ... steps away enumerate the paths
from the leaves to the roots, in as many rounds as the longest path has binary digits. Branches are
ranked by the sum of their scores, and each chosen path is formatted as one conversation with the
code points of its assistant texts as the loss mask.

Control strings start with ``<|``. Inside texts and roles that pair is written as an escape, as is
the escape character itself (and the line end inside roles), so the texts can be read back exactly.

Defined cases: null roles and texts are empty; a parent that is absent makes its child a root;
messages that form a cycle have no root and give no path; rows of equal turn are ordered by role and
text, repeated rows are turns of their own; rows of a null conversation form one conversation; an
empty table gives none; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>"
#: The escape character; rare, and escaped itself.
ESCAPE = "␛"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    return F.replace(text, F.lit("<|"), F.lit(f"{ESCAPE}1"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(f"{ESCAPE}2"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit(f"{ESCAPE}2"), F.lit("\n"))
    text = F.replace(text, F.lit(f"{ESCAPE}1"), F.lit("<|"))
    return F.replace(text, F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def threads(conversations: DataFrame) -> DataFrame:
    """Turn-ordered conversations as messages: each turn replies to the one before."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(tree.alias("tree"), "conv_id", "turn", "role", "text")
    return rows.select(
        "tree",
        F.col("conv_id").alias("name"),
        F.row_number().over(order).cast("long").alias("node"),
        (F.row_number().over(order) - 1).cast("long").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on the way from a leaf to its root, ``up`` steps away."""
    links = messages.select("tree", "node", "parent")
    known = messages.select("tree", F.col("node").alias("parent"))
    jumps = staged(links.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("far")))
    inner = jumps.select("tree", F.col("far").alias("node"))
    leaves = links.join(inner, ["tree", "node"], "left_anti")
    found = [staged(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")))]
    step, rows = 1, messages.count()
    while step <= rows:
        so_far = found[0]
        for part in found[1:]:
            so_far = so_far.unionByName(part)
        more = staged(
            so_far.join(jumps, ["tree", "node"]).select(
                "tree", "leaf", F.col("far").alias("node"), (F.col("up") + step).alias("up")
            )
        )
        if more.isEmpty():
            return so_far
        found.append(more)
        onward = jumps.select("tree", F.col("node").alias("far"), F.col("far").alias("next"))
        jumps = staged(jumps.join(onward, ["tree", "far"]).select("tree", "node", F.col("next").alias("far")))
        step *= 2
    so_far = found[0]
    for part in found[1:]:
        so_far = so_far.unionByName(part)
    return so_far


def format_branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen root-to-leaf path: ``name`` of its tree, ``leaf``, ``score``, ``rank``, the
    ``formatted`` conversation and ``loss_mask``, the code points of its assistant texts.

    ``best`` keeps that many branches of each tree, by score and then by leaf; None keeps all.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    along = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    written = (
        paths(messages)
        .join(messages, ["tree", "node"])
        .select(
            "tree", "leaf", "up", "name", "score",
            (role == "assistant").alias("learned"),
            F.length(head).alias("head_chars"),
            F.length(body).alias("body_chars"),
            F.concat(head, body, F.lit(f"{END}\n")).alias("piece"),
        )
        .withColumn("after", F.sum(F.length("piece")).over(along))
    )
    start = F.col("after") - F.length("piece") + F.col("head_chars")
    branches = (
        written.select(
            "tree", "leaf", "name", "score",
            F.struct(
                (-F.col("up")).alias("place"), "piece",
                F.when(F.col("learned"), F.struct(start.alias("start"), (start + F.col("body_chars")).alias("end"))).alias("mask"),
            ).alias("turn"),
        )
        .groupBy("tree", "leaf")
        .agg(F.first("name").alias("name"), F.sum("score").alias("score"), F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    if best is not None:
        ranked = staged(branches.withColumn("rank", F.row_number().over(order))).filter(F.col("rank") <= best)
    else:
        ranked = branches.withColumn("rank", F.lit(None).cast("int"))
    return ranked.select(
        "name", "leaf", "score", "rank",
        F.array_join("turns.piece", "").alias("formatted"),
        F.array_compact("turns.mask").alias("loss_mask"),
    )


def read_back(branches: DataFrame) -> DataFrame:
    """``turns`` (role and text) and the learned ``loss_text``, from the formatted text alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    tail = len(END) + 1

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        return F.struct(
            unescape(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece) - cut - tail)).alias("text"),
        )

    learned = F.transform(
        "loss_mask",
        lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))),
    )
    return branches.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(learned, ""))
