"""Reply trees to chat text: root-to-leaf paths by self-joins, branches ranked by score, one conversation a path.

The self-joins double their reach: after round k every node knows its ancestor 2**k steps up and the scores on the way
there, so a tree of depth d takes log2(d) rounds of one row a node.  Then every leaf knows the score of its path, the
best branches are chosen, and only their paths are listed, by the same steps.  DataFrame operations only.

Format of a turn: `### role: text` and a line `</turn>`.  In texts, `\\`, `###` and `</turn>` get a backslash in
front; in roles, `%`, `:`, `#`, `<` and line feeds are percent-encoded.  Both are undone by parse().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, new_path

HEAD, MID, END = "### ", ": ", "\n</turn>\n"
_ROLE = (("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"), ("\n", "%0A"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def _role_in(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_out(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _steps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Steps up by doubling, from nodes(conv, node, parent, score): the list of (conv, node, anc), anc being 2**k steps up in
    the k-th, and (conv, node, total, n) for every node that reaches a root, total and n summed over its whole path.

    A parent that isn't in the conversation makes its child a root.  Nodes that hang on a cycle reach no root.
    """
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("there"))
    anc = F.when(F.col("there"), F.col("parent")).alias("anc")
    one = F.lit(1).cast("long").alias("n")
    now = nodes.join(known, ["conv", "parent"], "left").select("conv", "node", anc, F.col("score").alias("total"), one)
    now, steps = durable(now, "chat-steps"), []
    most = int(math.log2(max(2, now.count()))) + 2
    for _ in range(most):
        going = now.where("anc is not null")
        if not going.limit(1).count():
            break
        steps.append(going.select("conv", "node", "anc"))
        above = [F.col("anc").alias("to"), F.col("total").alias("more"), F.col("n").alias("m")]
        over = now.select("conv", F.col("node").alias("anc"), *above)
        # A node with very many descendants is one row on the right.  Both sides are stored, so adaptive execution can
        # split the many rows on the left.
        sums = [F.col("total") + F.col("more"), F.col("n") + F.col("m")]
        moved = going.join(over, ["conv", "anc"]).select("conv", "node", F.col("to").alias("anc"), *sums)
        now = durable(now.where("anc is null").unionAll(moved), "chat-steps")
    return steps, now.where("anc is null").select("conv", "node", "total", "n")


def _paths(chosen: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(conv, leaf, node, dist) of the paths of chosen(conv, leaf), dist counted from the leaf."""
    spark = chosen.sparkSession
    found = chosen.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    schema, parts = found.schema, [new_path(spark, "chat-paths")]
    found.write.parquet(parts[0])
    for k, step in enumerate(steps):
        so_far = spark.read.schema(schema).parquet(*parts)
        parts.append(new_path(spark, "chat-paths"))
        further = so_far.join(step, ["conv", "node"])
        further.select("conv", "leaf", F.col("anc").alias("node"), (F.col("dist") + (1 << k)).alias("dist")).write.parquet(parts[-1])
    return spark.read.schema(schema).parquet(*parts)


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: (conv_id, leaf, branch, score, n_turns, formatted, loss_spans, turn_starts).

    messages(conv_id, node, parent, role, text, score): parent null for roots.  A path scores the mean of its nodes
    (null: 0); branches are ranked by score, ties by the smaller leaf, and the best `branches` are kept (None: all).
    loss_spans lists (turn, start, end) of the assistant texts in formatted, turn_starts where each turn begins, both in
    code points.  Null roles and texts count as empty; a null conv_id is a conversation of its own; of repeated
    (conv_id, node) the smallest row by role and text is taken; rows without a node are no messages; other columns are
    ignored; an empty table gives an empty table.  Texts are never cut: the formatted conversation is one string, so one row holds a whole path by contract.
    """
    kind = messages.schema["conv_id"].dataType
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id"), F.lit(0).cast(kind)).alias("id"))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}
    empty = texts | {"score": F.coalesce(F.col("score").cast("double"), F.lit(0.0))}
    rows = messages.select(F.to_json(conv).alias("conv"), "conv_id", "node", "parent", *[c.alias(k) for k, c in empty.items()])
    first = F.min(F.struct("role", "text", "score", "parent", "conv_id")).alias("m")
    rows = durable(rows.where("node is not null").groupBy("conv", "node").agg(first).select("conv", "node", "m.*"), "chat-rows")

    nodes = rows.select("conv", "node", "parent", "score")
    steps, whole = _steps(nodes)
    inner = nodes.select("conv", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = whole.join(inner, ["conv", "node"], "left_anti")
    leaves = leaves.select("conv", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf")).alias("branch")
    ranked = leaves.select("conv", "leaf", "path_score", rank)
    chosen = durable(ranked if branches is None else ranked.where(F.col("branch") <= branches), "chat-chosen")

    head = F.concat(F.lit(HEAD), _role_in(F.col("role")), F.lit(MID))
    loss = (F.col("role") == "assistant").alias("loss")
    turns = _paths(chosen, steps).join(rows.drop("score"), ["conv", "node"])
    turns = turns.select("conv", "conv_id", "leaf", "dist", loss, head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv", "leaf").orderBy(F.desc("dist"))
    begin = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    turns = turns.withColumn("begin", begin).withColumn("turn", (F.row_number().over(order) - 1).cast("int"))
    piece = F.concat("head", "body", F.lit(END)).alias("piece")
    item = F.struct("turn", "begin", piece, F.length("head").alias("head"), F.length("body").alias("body"), "loss")
    whole = turns.groupBy("conv", "leaf").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(item)).alias("t"))

    def span(x: Column) -> Column:
        start = x["begin"] + x["head"]
        return F.struct(x["turn"].alias("turn"), start.alias("start"), (start + x["body"]).alias("end"))

    return whole.join(chosen, ["conv", "leaf"]).select(
        "conv_id",
        "leaf",
        "branch",
        F.col("path_score").alias("score"),
        F.size("t").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), span).alias("loss_spans"),
        F.transform("t", lambda x: x["begin"]).alias("turn_starts"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), both as they were before formatting."""

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, ":")
        role = F.substring(piece, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        text = F.substring(piece, colon + len(MID), F.length(piece))
        return F.struct(_role_out(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, END), lambda x: x != ""), turn)


def under_mask(formatted: Column, loss_spans: Column, turn_starts: Column) -> Column:
    """The text under the loss mask, unescaped: each span is cut from its own turn, so the cost is linear."""
    pieces = F.split(formatted, END)

    def cut(s: Column) -> Column:
        piece, begin = F.element_at(pieces, s["turn"] + 1), F.element_at(turn_starts, s["turn"] + 1)
        return unescape(F.substring(piece, (s["start"] - begin + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return F.array_join(F.transform(loss_spans, cut), "")


def as_tree(turns: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as messages whose parents are the turns before; repeated turns follow each other."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
