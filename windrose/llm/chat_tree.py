"""Chat formatting of reply trees (operator 3).

Messages point at the message they answer. Self-joins that double the distance they look back find every message's
depth, root and summed score in as many rounds as the logarithm of the deepest reply; the same doubled steps then list
the messages of each chosen branch, so a conversation of hundreds of turns takes ten joins. The branches of a tree are
ranked by score, and each chosen one, from root to leaf, is formatted as one conversation.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Control strings inside roles and texts get a
backslash behind their first character and backslashes are doubled, so formatting can be undone. Only DataFrame
operations are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates in public use give a meaning.
CONTROL = [
    START,
    SEPARATOR,
    END,
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|eot_id|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|begin_of_text|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
]
_CONTROL = "([<\\[])(?=" + "|".join(re.escape(c[1:]).replace("/", "\\/") for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    """A null is an empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations of numbered turns as trees of one branch: tree_id, node_id, parent_id, role, text, score.

    Turns are ordered by number (null first), role and text; repeated rows are turns of their own. Turns with a null conv_id are one conversation.
    """
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv_id).alias("tree_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return numbered.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _ancestry(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Steps of 1, 2, 4 ... back (tree_id, node_id, up); depth and total score of each node; folders to remove.

    A parent that isn't there, or is the node itself, makes a root. Nodes on a cycle: the one with the least id is a root.
    """
    spark = nodes.sparkSession
    base, path = common.saved(nodes.select("tree_id", "node_id", "parent_id", "score"), "chat-nodes")
    folders = [path]
    known = base.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    linked = base.join(known, ["tree_id", "parent_id"], "left").select("tree_id", "node_id", F.when(F.col("there") & (F.col("parent_id") != F.col("node_id")), F.col("parent_id")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    now, path = common.saved(linked.withColumns({"depth": F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"), "least": F.least("node_id", "up")}), "chat-steps")
    folders.append(path)
    steps: list[DataFrame] = []
    settled: list[DataFrame] = []
    limit = max(1, base.count()).bit_length() + 1
    while True:
        going = now.where("up IS NOT NULL")
        settled.append(now.where("up IS NULL").select("tree_id", "node_id", "depth", "total"))
        if going.isEmpty():
            break
        if len(steps) > limit:
            roots = going.select("tree_id", F.col("up").alias("node_id")).distinct().join(now, ["tree_id", "node_id"]).groupBy("tree_id", "least").agg(F.count("*").alias("n")).select("tree_id", F.col("least").alias("node_id"), F.lit(True).alias("cut"))
            opened = nodes.join(roots, ["tree_id", "node_id"], "left").withColumn("parent_id", F.when(F.col("cut"), None).otherwise(F.col("parent_id"))).drop("cut")
            opened, path = common.saved(opened, "chat-opened")
            common.remove(spark, *folders)
            steps, depths, folders = _ancestry(opened)
            return steps, depths, [path, *folders]
        steps.append(going.select("tree_id", "node_id", "up"))
        # what stands further up: of nodes already settled in an earlier round too
        above = now if len(settled) == 1 else now.select("tree_id", "node_id", "up", "total", "depth", "least").unionByName(_all(settled[:-1]).withColumns({"up": F.lit(None).cast(now.schema["up"].dataType), "least": F.col("node_id")}))
        above = above.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("deeper"), F.col("least").alias("lesser"))
        joined = going.join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"), F.least("least", "lesser").alias("least"))
        now, path = common.saved(joined, "chat-steps")
        folders.append(path)
    return steps, _all(settled), folders


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def formatted_branches(messages: DataFrame, *, best: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The ``best`` branches of each tree, or all of them, each formatted as one conversation.

    ``messages`` has tree_id, node_id (long), parent_id (null: a root), role, text and score; other columns are ignored.
    Returned are tree_id, leaf_id, branch_rank (by mean score, best first; ties by leaf_id), branch_score, n_turns,
    formatted, and loss_spans: the code point ranges (start, length) of the texts of ``loss_roles`` in ``formatted``.

    A null text or role is empty, a null score 0. Of rows that repeat tree and node, the least (parent, role, text) stays.
    A parent that is missing makes a root, and so does the least node of a cycle. Messages with a null tree_id are one tree;
    one with a null node_id is a leaf of its own, as nothing can answer it. Texts of any length are formatted whole; a branch
    is one row. Empty tables give empty ones.
    """
    spark = messages.sparkSession
    message = F.struct("parent_id", "role", "text", "score")
    # keys are structs: those never are null, and null fields in them are equal, so every join matches them
    own = F.when(F.col("node_id").isNull(), F.sha2(F.to_json(message), 256))
    keyed = messages.select(F.struct(F.col("tree_id").alias("id")).alias("tree_id"), F.struct(F.col("node_id").alias("id"), own.alias("own")).alias("node_id"), message.alias("m"))
    rows = keyed.groupBy("tree_id", "node_id").agg(F.min("m").alias("m"))
    parent = F.when(F.col("m.parent_id").isNotNull(), F.struct(F.col("m.parent_id").alias("id"), F.lit(None).cast("string").alias("own")))
    whole = rows.select("tree_id", "node_id", parent.alias("parent_id"), "m.role", "m.text", "m.score")
    steps, depths, folders = _ancestry(whole.select("tree_id", "node_id", "parent_id", "score"))
    answered = steps[0].select("tree_id", F.col("up").alias("node_id")).distinct() if steps else depths.select("tree_id", "node_id").limit(0)
    leaves = depths.join(answered, ["tree_id", "node_id"], "left_anti").withColumn("branch_score", F.col("total") / (F.col("depth") + 1))
    ranked = leaves.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "node_id")).cast("long"))
    chosen = ranked if best is None else ranked.where(F.col("branch_rank") <= best)
    members, path = common.saved(chosen.select("tree_id", F.col("node_id").alias("leaf_id"), "branch_rank", "branch_score", "node_id", F.lit(0).cast("long").alias("back")), "chat-branches")
    folders.append(path)
    for k, step in enumerate(steps):
        further = members.join(step, ["tree_id", "node_id"]).select("tree_id", "leaf_id", "branch_rank", "branch_score", F.col("up").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        members, path = common.saved(members.unionByName(further), "chat-branches")
        folders.append(path)
    turns = members.join(whole.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    pieces = turns.withColumns({"head": head, "body": escaped(F.col("text"))}).withColumn("piece", F.concat("head", "body", F.lit(END)))
    branch = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("back"))
    placed = pieces.withColumn("upto", F.sum(F.char_length("piece")).over(branch)).withColumn("start", F.col("upto") - len(END) - F.char_length("body"))
    span = F.when(F.coalesce("role", F.lit("")).isin(*loss_roles), F.struct(F.col("start").cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    gathered = placed.groupBy("tree_id", "leaf_id").agg(F.min("branch_rank").alias("branch_rank"), F.min("branch_score").alias("branch_score"), F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "piece", span.alias("span")))).alias("turns"))
    out = gathered.select(F.col("tree_id.id").alias("tree_id"), F.col("leaf_id.id").alias("leaf_id"), "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda x: x.isNotNull()).alias("loss_spans"))
    result, _ = common.saved(out, "chat-formatted")
    common.remove(spark, *folders)
    return result


def parsed(formatted: Column) -> Column:
    """Array of (role, text), undoing the template and its escapes."""
    turns = F.slice(F.split(formatted, re.escape(START)), 2, 1 << 30)
    parts = F.transform(turns, lambda t: F.split(F.substring_index(t, END, 1), re.escape(SEPARATOR)))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
