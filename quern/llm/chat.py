"""Chat formatting of reply trees, with DataFrame operations only.

A message has a tree, an id, its parent's id (null at a root), a role, a text and a score.
Every leaf ends one branch.  ``branches`` finds the messages of all branches by iterative
self-joins that double the distance to the ancestor reached, so a branch of n messages takes
log2(n) rounds; ids only take part, texts are joined at the end.  ``best`` ranks the branches of each
tree by total score (ties: the smaller leaf id first).  ``render`` makes one conversation of
each branch; ``parse`` reads it back.

The template of a message is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Within texts and roles,
``<``, any number of ``\\`` and ``|`` gets one more ``\\`` after the ``<``, so no control string can
occur there, and removing one restores the text.  In roles ``%`` and line feeds are written %25 and %0A too.

Defined results: null texts and roles are empty, null scores 0; a parent that isn't in
the tree makes a message a root; messages on or below a cycle belong to no branch and give no
conversation; a null tree is a tree of its own; repeated ids of a tree are one message's copies
and each gives its own branches, so callers number repeated rows first (as ``from_turns`` does).
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Reply trees of linear conversations: each turn answers the one before (nulls last; ties by role and text)."""
    order = Window.partitionBy("tree").orderBy(F.col("t").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = turns.select(F.col(conv).alias("tree"), F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))
    n = F.row_number().over(order).cast("bigint")
    return rows.select("tree", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message of every root-to-leaf path, up steps above its leaf."""
    ids = checkpoint(nodes.select("tree", "node", "parent"))
    known = ids.select(F.col("tree").alias("kt"), F.col("node").alias("kn")).distinct()
    parents = ids.where("parent is not null")
    held = parents.join(known, parents["tree"].eqNullSafe(known["kt"]) & (parents["parent"] == known["kn"]), "left_semi")
    jump = held.select("tree", "node", F.col("parent").alias("to")).distinct()
    asked = held.select(F.col("tree").alias("kt"), F.col("parent").alias("kn")).distinct()
    leaves = ids.join(asked, ids["tree"].eqNullSafe(asked["kt"]) & (ids["node"] == asked["kn"]), "left_anti")
    pairs = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    first, step = jump, 1
    largest = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while step <= largest:
        jump = checkpoint(jump)
        if jump.isEmpty():
            break
        far = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "to")
        on = pairs["tree"].eqNullSafe(far["jt"]) & (pairs["node"] == far["jn"])
        pairs = checkpoint(pairs.unionByName(pairs.join(far, on).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))))
        left = jump.alias("l")
        right = jump.select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("to").alias("jto")).alias("r")
        jump = left.join(right, F.col("l.tree").eqNullSafe(F.col("r.jt")) & (F.col("l.to") == F.col("r.jn"))).select("tree", "node", F.col("jto").alias("to"))
        step *= 2
    # a branch counts only if it comes to a root: below a cycle there is none
    inner = first.select(F.col("tree").alias("kt"), F.col("node").alias("kn"))
    roots = pairs.join(inner, pairs["tree"].eqNullSafe(inner["kt"]) & (pairs["node"] == inner["kn"]), "left_anti")
    whole = roots.select(F.col("tree").alias("kt"), F.col("leaf").alias("kl")).distinct()
    return pairs.join(whole, pairs["tree"].eqNullSafe(whole["kt"]) & (pairs["leaf"] == whole["kl"]), "left_semi")


def best(paths: DataFrame, nodes: DataFrame, top: int | None) -> DataFrame:
    """(tree, leaf, rank, path_score) of the ``top`` branches of every tree; None: of all."""
    scores = nodes.select(F.col("tree").alias("st"), F.col("node").alias("sn"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    joined = paths.join(scores, paths["tree"].eqNullSafe(scores["st"]) & (paths["node"] == scores["sn"]))
    total = joined.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def render(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, n_turns, formatted, loss_spans) of the chosen branches.

    loss_spans holds (start, end) in code points of formatted, one for each assistant message."""
    nodes = checkpoint(nodes.select("tree", "node", "parent", "role", "text", "score"))  # read three times below
    paths = branches(nodes)
    chosen = best(paths, nodes, top).select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank", "path_score")
    kept = paths.join(chosen, paths["tree"].eqNullSafe(chosen["ct"]) & (paths["leaf"] == chosen["cl"])).drop("ct", "cl")
    said = nodes.select(F.col("tree").alias("st"), F.col("node").alias("sn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.select("st", "sn", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    rows = kept.join(said, kept["tree"].eqNullSafe(said["st"]) & (kept["node"] == said["sn"])).drop("st", "sn")
    tail = F.lit(END + "\n")
    turns = rows.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "loss"))).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(turn["head"])
        end = begin + F.length(turn["body"])
        span = F.when(turn["loss"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END) + 1).alias("at"), F.concat(done["spans"], span).alias("spans"))

    return turns.select(
        "tree", "leaf", "rank", "path_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"),
        F.aggregate("turns", start, advance, lambda done: done["spans"]).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array of (role, text): the messages of a formatted conversation, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - len(END) - 2)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
