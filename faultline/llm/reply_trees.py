"""Reply trees formatted as conversations, in DataFrame functions.

Nodes (tree, node, parent, role, text, score) form trees; a node whose parent is null or absent is a root.  Doubling
self-joins find each node's ancestors at distances 1, 2, 4, ... and the sum of the scores up to the root, so a tree of
depth d takes log2(d) joins.  The leaves of a tree are ranked by the score of their path (ties: smaller node);
the nodes of a chosen path are its leaf and, joining from the longest distance down, all ancestors.  Each path is
formatted as one conversation::

    <|im_start|>role
    text<|im_end|>

Control strings inside roles and texts are written as ``~1``, ``~2``, ...; ``~`` itself as ``~0``, a line break in a role
as ``~n``.  So the marks in the output are the template's alone and reading back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import materialize

# Control strings of common chat templates; the first two are ours.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, STOP = CONTROL[0], CONTROL[1] + "\n"
#: Codes after ``~``: 1 to 9, then letters but n.
CODES = "123456789a"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("~"), F.lit("~0"))
    for code, s in zip(CODES, CONTROL):
        c = F.replace(c, F.lit(s), F.lit("~" + code))
    return c


def unescape(c: Column) -> Column:
    for code, s in zip(CODES, CONTROL):
        c = F.replace(c, F.lit("~" + code), F.lit(s))
    return F.replace(c, F.lit("~0"), F.lit("~"))


def _same(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Equi-join inside trees; b's columns: tree2, ...  Null tree ids are one tree."""
    return a.join(b, a["tree"].eqNullSafe(b["tree2"]) & (a[left] == b[right]), how)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (tree, node): of repeated ones that with the smallest text, then role, parent and score (nulls first).
    Other columns are dropped; an empty table stays empty."""
    least = F.min(F.struct("text", "role", "parent", "score")).alias("least")
    return nodes.groupBy("tree", "node").agg(least).select("tree", "node", "least.*")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes(tree, node, parent, score, role, text, ...), repeated rows and all -> ``format_paths`` of the ``branches``
    best paths of each tree."""
    nodes = materialize(distinct_nodes(nodes), "nodes")
    return format_paths(chosen_paths(nodes, branches), nodes)


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One row per (tree, node) (``distinct_nodes``): nodes(tree, node, parent, score) -> tree, path (leaf), rank, node, depth: the nodes of the ``branches`` best
    root-to-leaf paths of each tree; depth 0 is the leaf's end of the path.  Nodes on a cycle belong to no path."""
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"))
    linked = _same(base, known, "parent", "node2", "left")
    up = linked.select("tree", "node", F.col("node2").alias("to"), "score")
    up = materialize(up, "up")
    most = up.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, distance = [], 1
    # up: node -> ancestor at ``distance`` (null beyond the root), and the scores of the nodes before it.
    while distance <= most and not up.where("to IS NOT NULL").isEmpty():
        jumps.append((distance, up))
        then = up.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.col("to").alias("to2"), F.col("score").alias("score2"))
        # Nodes that have reached their root are done; only the others go on.
        both = _same(up.where("to IS NOT NULL"), then, "to", "node2")
        on = both.select("tree", "node", F.col("to2").alias("to"), (F.col("score") + F.col("score2")).alias("score"))
        up = materialize(on.unionByName(up.where("to IS NULL")), "up")
        distance *= 2
    parents = base.where("parent IS NOT NULL").select(F.col("tree").alias("tree2"), F.col("parent").alias("parent2")).distinct()
    leaves = _same(up.where("to IS NULL"), parents, "node", "parent2", "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = best.select("tree", F.col("node").alias("path"), "rank", "node", F.lit(0).cast("long").alias("depth"))
    for distance, jump in reversed(jumps):
        to = jump.where("to IS NOT NULL").select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), "to")
        more = _same(path, to, "node", "node2").select("tree", "path", "rank", F.col("to").alias("node"), (F.col("depth") + distance).alias("depth"))
        path = materialize(path.unionByName(more), "path")
    return path


def format_paths(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """-> tree, path, rank, formatted, mask (array of (start, end): the assistant texts, code points, end exclusive)."""
    what = nodes.select(F.col("tree").alias("tree2"), F.col("node").alias("node2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _same(path, what, "node", "node2").select("tree", "path", "rank", "depth", "role", "text")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~n")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(STOP)))
    along = Window.partitionBy("tree", "path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("turn")).over(along) - len(STOP))
    rows = rows.withColumn("span", F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.length("body")).alias("start"), "end")))
    turn = F.struct((-F.col("depth")).alias("no"), "turn")
    out = rows.groupBy("tree", "path", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sort_array(F.collect_list("span")).alias("mask"))
    return out.select("tree", "path", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "mask")


def read_back(formatted: str = "formatted") -> Column:
    """Array of (role, text) from a formatted conversation."""
    turns = F.filter(F.split(F.col(formatted), r"<\|im_start\|>"), lambda t: t != "")

    def turn(t):
        role = F.substring_index(t, "\n", 1)
        text = F.substring(t, F.length(role) + 2, F.length(t) - F.length(role) - 1 - len(STOP))
        return F.struct(unescape(F.replace(role, F.lit("~n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: str = "formatted", mask: str = "mask") -> Column:
    """The text under the loss mask, unescaped."""
    parts = F.transform(mask, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")


def thread_nodes(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> nodes: each row replies to the one before it by turn (null first),
    then role and text, so every row, also a repeated one, is a turn.  A node's score is the length of its text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).cast("long").alias("node"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.withColumn("parent", parent).withColumn("score", F.coalesce(F.length("text"), F.lit(0)).cast("double"))


def format_threads(conversations: DataFrame) -> DataFrame:
    """-> conv_id, formatted, mask: one row per conversation, its best root-to-leaf path."""
    nodes = materialize(thread_nodes(conversations), "nodes")
    return format_paths(chosen_paths(nodes), nodes).select(F.col("tree").alias("conv_id"), "formatted", "mask")
