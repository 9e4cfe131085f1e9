"""Chat formatting of reply trees, in DataFrame functions only.

Self-joins by doubling walk from every node to its root: after round k a node
knows its 2^k-th ancestor and the score of the 2^k nodes up to it, so paths of n
turns take about log2(n) rounds. The sums rank the leaves of each tree; only the
paths of the chosen leaves are then enumerated, by the same rounds, and each
becomes one conversation.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``<|``,
``<\\|``, ``<\\\\|`` and so on gain one backslash, so no text holds a control
string and the step can be undone. In roles ``%`` and the newline are written
``%25`` and ``%0A``. The loss mask holds the spans (code points, end exclusive)
of the texts of the roles that are learnt.

Null role or text is empty, a null score 0. A null tree is a tree of its own. A
node whose parent is null or missing is a root. Nodes on a cycle reach no root and
are on no path; a null node takes no part. Of several rows of one node the least
parent counts, their scores add up and each is a turn. Other columns are ignored;
an empty table gives no rows. A conversation of any length is one row at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import cut

START, END = "<|im_start|>", "<|im_end|>"
END_SPLIT = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def linear_tree(rows: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Conversations without branches as trees: each turn replies to the one before.

    Rows are numbered by ``order``, equal ones by role and text, so repeated rows
    are further turns.
    """
    named = rows.select(
        F.col(f"`{tree}`").alias("tree"),
        F.col(f"`{order}`").alias("order"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    number = F.row_number().over(Window.partitionBy("tree").orderBy("order", "role", "text")).cast("long")
    node = named.withColumn("node", number)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return node.select("tree", "node", parent.alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, leaf, score`` of every root-to-leaf path, and for each k ``tree, node, above``, the 2^k-th ancestors."""
    rows = nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    rows = cut(rows)
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    of = F.col("tree").eqNullSafe(F.col("t"))
    at = cut(rows.join(known, of & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("above"), "score"))
    replied = at.where("above IS NOT NULL").select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = cut(at.join(replied, of & (F.col("node") == F.col("n")), "left_anti").select("tree", F.col("node").alias("leaf")))
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels: list[DataFrame] = []
    # nodes whose root is reached leave the rounds
    walking, rooted = at.where("above IS NOT NULL"), at.where("above IS NULL")
    while 1 << len(levels) <= most and not walking.isEmpty():
        levels.append(walking.select("tree", "node", "above"))
        over = walking.unionByName(rooted).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("further"), F.col("score").alias("more"))
        summed = walking.join(over, of & (F.col("above") == F.col("n"))).select("tree", "node", F.col("further").alias("above"), (F.col("score") + F.col("more")).alias("score"))
        summed = cut(summed)
        walking, rooted = summed.where("above IS NOT NULL"), rooted.unionByName(summed.where("above IS NULL"))
    total = rooted.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    return leaves.join(total, of & (F.col("leaf") == F.col("n"))).select("tree", "leaf", "score"), levels


def paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``leaves`` with ``node, up``: every node of their paths, ``up`` steps above the leaf."""
    held = cut(leaves.withColumns({"node": F.col("leaf"), "up": F.lit(0).cast("long")}))
    for k, level in enumerate(levels):
        over = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        further = held.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        held = cut(held.unionByName(further.withColumns({"node": F.col("above"), "up": F.col("up") + (1 << k)}).drop("t", "n", "above")))
    return held


def format_trees(nodes: DataFrame, learn: tuple[str, ...] = ("assistant",), keep: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, branch, score, ``formatted``, ``mask``.

    ``nodes`` has tree, node, parent, role, text, score. A path's score is the sum
    of its nodes' scores; ``keep`` keeps the best branches of each tree (ties to
    the smaller leaf), None all of them, whose ``branch`` is then null.
    """
    nodes = cut(nodes)
    leaves, levels = ancestors(nodes)
    if keep is None:
        leaves = leaves.withColumn("branch", F.lit(None).cast("int"))
    else:
        best = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        leaves = leaves.withColumn("branch", best).where(F.col("branch") <= keep)
    n = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths(leaves, levels).join(n, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "branch", "score", "up", "role", "text")
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turn = F.struct((-F.col("up")).alias("depth"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*learn).alias("learn"))
    grouped = turns.groupBy("tree", "leaf", "branch", "score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    spans = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {spans})").alias("found"))

    def mark(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(x["learn"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    mask = F.aggregate("turns", start, mark, lambda acc: acc["found"])
    return grouped.select("tree", "leaf", "branch", "score", text.alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted conversation: array of role and text."""
    pieces = F.split(formatted, END_SPLIT, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(F.substring(piece, F.lit(len(START) + 1), F.length(piece)), "\n", 1)
        body = F.substring(piece, F.length(head) + len(START) + 2, F.length(piece))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")


