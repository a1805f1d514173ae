r"""Reply trees to training conversations.

A tree's nodes name their parents. Root-to-leaf paths come from iterative
self-joins: ``jump[k]`` holds each node's ancestor 2^k steps up and the sum of
the scores on the way (``jump[k+1] = jump[k] ⋈ jump[k]``). Every leaf is
carried to its root by joining with ``jump[k]`` for falling k, one row a leaf,
which gives its depth and its score; branches are ranked by mean score, and only
the chosen ones list their ancestors, again for falling k. A tree of n nodes
and depth d takes about 3·log2(d) joins of at most n rows, besides the paths
that are asked for. Each chosen path is formatted as one conversation with its
loss mask.

Template, one block a turn: ``<|im_start|>`` role ``\n`` text ``<|im_end|>\n``.
Inside roles and texts a ``<``, any number of backslashes and a ``|`` get one
more backslash, so control strings never occur there; one backslash less
restores them. In roles a backslash is doubled and a newline written as ``\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import drop_table, empty_if_null, materialize

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(role)


def _unescape_role(role: Column) -> Column:
    role = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(role, F.lit("\\\\"), F.lit("\\"))


def _same(tree: str, node: str) -> Column:
    """The tree (null equals null) and node that columns t and n name."""
    return F.col(tree).eqNullSafe(F.col("t")) & (F.col(node) == F.col("n"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Written tables (t, n, anc, steps_sum), one for each power of two, and
    the nodes that lead into a cycle (None: there is no cycle).

    ``steps_sum`` sums the scores from the node up to the one below ``anc``."""
    own = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = materialize(nodes.where("parent is not null")
                     .join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")))
                     .select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("anc"),
                             F.col("score").alias("steps_sum")))
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [up]
    while not jumps[-1].isEmpty():
        if 2 ** (len(jumps) - 1) >= largest:  # a proper path has fewer steps: these run into a cycle
            return jumps[:-1], jumps[-1]
        a = jumps[-1].select(F.col("t").alias("tree"), F.col("n").alias("node"), F.col("anc").alias("mid"), F.col("steps_sum").alias("low"))
        jumps.append(materialize(a.join(jumps[-1], _same("tree", "mid"))
                                 .select(F.col("tree").alias("t"), F.col("node").alias("n"), "anc",
                                         (F.col("low") + F.col("steps_sum")).alias("steps_sum"))))
    drop_table(jumps[-1])
    return jumps[:-1], None


def _leaf_scores(nodes: DataFrame, jumps: list[DataFrame], loops: DataFrame | None) -> DataFrame:
    """(tree, leaf, length, score): each leaf with a root, the nodes of its
    path and their mean score."""
    at = nodes
    if jumps:
        inner = jumps[0].select("t", F.col("anc").alias("n")).distinct()
        at = at.join(inner, _same("tree", "node"), "left_anti")
    if loops is not None:
        at = at.join(loops.select("t", "n"), _same("tree", "node"), "left_anti")
    at = at.select("tree", F.col("node").alias("leaf"), "node", F.lit(1).cast("bigint").alias("length"), F.lit(0.0).alias("total"))
    for k in reversed(range(len(jumps))):
        gone = F.col("anc").isNotNull()
        at = at.join(jumps[k], _same("tree", "node"), "left").select(
            "tree", "leaf", F.coalesce("anc", "node").alias("node"), F.when(gone, F.col("length") + 2 ** k).otherwise(F.col("length")).alias("length"),
            F.when(gone, F.col("total") + F.col("steps_sum")).otherwise(F.col("total")).alias("total"))
    root = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    return (at.join(root, _same("tree", "node"))
            .select("tree", "leaf", "length", ((F.col("total") + F.col("score")) / F.col("length")).alias("score")))


def rank_branches(scores: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, length, branch) of each tree's ``top`` rows of (tree, leaf,
    length, score) (None: all) by score, then length, then smaller leaf."""
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf")
    best = scores.withColumn("branch", F.row_number().over(order))
    return (best if top is None else best.where(F.col("branch") <= top)).select("tree", "leaf", "length", "branch")


def branch_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of every tree of ``nodes`` (tree, node,
    parent, score), ranked by mean score: one row (tree, leaf, branch, node,
    depth) for each node of a path, depth 0 at the root.

    A parent that the tree lacks counts as none. Nodes below a cycle have no
    root and lie on no path. Null trees are one tree; null nodes are no nodes;
    null scores count as 0.
    """
    ids = materialize(nodes.where("node is not null")
                      .select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    jumps, loops = _jumps(ids)
    chosen = materialize(rank_branches(_leaf_scores(ids, jumps, loops), top))
    paths = chosen.select("tree", "leaf", "branch", F.col("leaf").alias("node"), (F.col("length") - 1).alias("depth"))
    for k in reversed(range(len(jumps))):
        both = F.array(F.struct("node", "depth"), F.struct(F.col("anc").alias("node"), (F.col("depth") - 2 ** k).alias("depth")))
        paths = (paths.join(jumps[k], _same("tree", "node"), "left")
                 .select("tree", "leaf", "branch", F.inline(both)).where("node is not null"))
    out = materialize(paths)
    for t in (ids, chosen, *jumps, *([] if loops is None else [loops])):
        drop_table(t)
    return out


def format_branches(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """One conversation for each chosen path of ``nodes`` (tree, node, parent,
    role, text, score; other columns are ignored).

    Returns tree, leaf, branch (from 1), formatted, loss_spans (array of
    start, end: code points of the assistant texts inside ``formatted``). Null
    roles and texts are empty. Of rows with the same tree and node the first
    by parent, role and text counts. An empty table gives no rows. A path is
    one output row, so its turns meet in one task; trees do not.
    """
    order = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    one = materialize(nodes.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score"))
                      .withColumn("first", F.row_number().over(order)).where("first = 1").drop("first"))
    paths = branch_paths(one, top)
    own = one.select(F.col("tree").alias("t"), F.col("node").alias("n"),
                     empty_if_null("role").alias("role"), empty_if_null("text").alias("text"))
    turns = paths.join(own, _same("tree", "node"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", "branch", "depth", F.col("role").eqNullSafe(F.lit(LOSS_ROLE)).alias("loss"),
                         head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    so_far = (Window.partitionBy("tree", "leaf", "branch").orderBy("depth")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.withColumn("stop", F.sum(size.cast("bigint")).over(so_far) - len(END))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("block"), "loss",
                    (F.col("stop") - F.char_length("body")).alias("start"), F.col("stop").alias("end"))
    path = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return path.select(
        "tree", "leaf", "branch", F.array_join(F.transform("turns", lambda x: x["block"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["loss"]),
                    lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    bare = F.transform(blocks, lambda b: F.substr(b, F.lit(len(START) + 1)))
    return F.transform(bare, lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees of one branch:
    each row answers the one before it by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(1.0).alias("score"))
