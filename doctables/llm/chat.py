"""Reply trees as conversations: paths from root to leaf, ranked, and written by a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.llm.work import forget, saved

# Fixed values of the template: <turn role>text</turn> and a line end per turn. Inside
# roles and texts \ < > are written \b \l \g, so control strings stand nowhere else.
OPEN, NAMED, CLOSE = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def linear_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of plain conversations as replies: each row answers the one before it by turn.

    Rows of equal turn follow by role, then text, NULL first; NULL turns come first.
    Rows without a conversation id form one conversation of their own.
    """
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    return turns.select(
        F.col(conv).cast("long").alias("tree"),
        F.row_number().over(order).cast("long").alias("node"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    ).selectExpr("tree", "node", "if(node > 1, node - 1, null) as parent", "role", "text", "0.0D as score")


def root_paths(replies: DataFrame) -> DataFrame:
    """One row (tree, leaf, node, up) per node of every path from a leaf up to its root; up is 0 at the leaf.

    replies has tree, node, parent, score; (tree, node) is unique, NULL trees are one
    tree. A parent that is not there makes a root. Links double with every self-join:
    after k rounds each path holds the 2^k nodes next to its leaf, so a conversation
    of n turns takes log2(n) rounds. A circle of replies has no leaf or leads a leaf
    round and round; that raises ValueError.
    """
    nodes = replies.select(F.coalesce("tree", F.lit(-(1 << 63))).alias("tree"), "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    step = saved(nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("ancestor")))
    leaves = nodes.join(step.select("tree", F.col("ancestor").alias("node")), ["tree", "node"], "left_anti")
    paths = saved(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    limit, size = nodes.count(), 1
    while step.limit(1).count():
        if size > 2 * limit:
            raise ValueError("replies form a circle")
        more = paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("ancestor").alias("node"), (F.col("up") + size).alias("up"))
        longer = saved(paths.union(more))
        onward = step.select("tree", F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        twice = saved(
            step.join(onward, ["tree", "ancestor"]).select("tree", "node", F.col("further").alias("ancestor"))
        )
        forget(paths)
        forget(step)
        paths, step, size = longer, twice, size * 2
    return paths


def format_paths(replies: DataFrame, loss_role: str = "assistant", best: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, place, path_score, n_turns, formatted, loss_spans.

    replies has tree, node, parent, role, text, score. All paths of a tree are ranked
    by the sum of their scores (NULL counts 0), the larger first, then the smaller
    leaf; `best` keeps that many per tree (None: all). formatted is the template over
    the path from the root on; loss_spans gives (start, size) in characters of the
    escaped texts of `loss_role`. NULL text or role counts as empty. One path is one
    value, as its output is.
    """
    paths = root_paths(replies)
    rows = replies.withColumn("tree", F.coalesce("tree", F.lit(-(1 << 63))))
    scored = (
        paths.join(rows.select("tree", "node", "score"), ["tree", "node"])
        .groupBy("tree", "leaf")
        .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"), F.count(F.lit(1)).alias("n_turns"))
    )
    ranked = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    chosen = scored.withColumn("place", F.row_number().over(ranked))
    if best is not None:
        chosen = chosen.filter(F.col("place") <= best)
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    written = rows.select(
        "tree", "node", F.concat(F.lit(OPEN), role, F.lit(NAMED)).alias("head"), text.alias("body"),
        (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
    )
    turns = paths.join(written, ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "loss"))).alias("turns")
    )
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    walk = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")),
        lambda so, t: F.struct(
            (so["end"] + size(t)).alias("end"),
            F.when(
                t["loss"],
                F.concat(so["spans"], F.array(F.struct((so["end"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("size")))),
            ).otherwise(so["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return chosen.join(turns.select("tree", "leaf", formatted.alias("formatted"), walk["spans"].alias("loss_spans")), ["tree", "leaf"]).select(
        F.when(F.col("tree") != -(1 << 63), F.col("tree")).alias("tree"), "leaf", "place", "path_score", "n_turns", "formatted", "loss_spans"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted rows hold: tree, leaf, turns (array of role and text), loss_text, formatted_chars."""
    parts = F.slice(F.split("formatted", "</turn>\n", -1), 1, F.size(F.split("formatted", "</turn>\n", -1)) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), NAMED, 1)).alias("role"),
        unescape(F.substring_index(p, NAMED, -1)).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["size"]))
    return formatted.select(
        "tree", "leaf", F.transform(parts, turn).alias("turns"), unescape(F.array_join(masked, "")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
