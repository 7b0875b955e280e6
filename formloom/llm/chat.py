"""Chat formatting: reply trees to conversations with a loss mask; DataFrame functions only.

``reply_paths`` takes messages with ``tree``, ``node``, ``parent``, ``place``,
``role``, ``text`` and ``score``. Self-joins that double the jump (parent,
grandparent, 4th, 8th ancestor, ...) give each message its depth and the score
of its path in log2(depth) rounds; leaves are ranked within their tree by path
score; the chosen leaves walk the same jumps back, each binary digit of the
distance doubling what they hold, so that every message of a chosen path turns
up exactly once.

Template: ``<s>`` opens and ``</s>`` closes a turn; user text stands between
``[INST] `` and `` [/INST]``, system text between ``[SYS] `` and `` [/SYS]``,
assistant text bare, any other role after ``[ROLE]name[/ROLE]``. A control
string inside a text gets one backslash behind its bracket, one more if it has
some already; taking one away again gives the text back.

Defined cases: a null text or role is empty; a link to a missing message, to
itself or to one that doesn't stand before its reply (``place``) is no link, so
that the message is a root and cycles cannot arise; equal scores are ranked by
node; messages of a null tree are one tree; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import cut

# Fixed values of the template.
OPEN, CLOSE = "<s>", "</s>"
WRAPS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "")}
CONTROL = r"(/?(?:s>|INST\]|SYS\]|ROLE\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def turns_in_order(rows: DataFrame, tree: str, place: str) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before."""
    order = Window.partitionBy(tree).orderBy(place, "role", "text")
    rows = rows.select(tree, place, "role", "text").withColumn("_at", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col(tree).alias("tree"), F.col("_at").alias("node"), F.when(F.col("_at") > 1, F.col("_at") - 1).alias("parent"),
        F.col("_at").alias("place"), "role", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("score"),
    )


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node) of the ``top`` best root-to-leaf paths of each tree.

    A path's score is the mean score of its messages.
    """
    return _paths(_keyed(messages), top).withColumn("tree", F.col("tree.of"))


def _keyed(messages: DataFrame) -> DataFrame:
    """The same messages with a tree that is never null, so that joins keep the null tree."""
    return messages.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.col("tree").alias("of")))


def _paths(messages: DataFrame, top: int) -> DataFrame:
    nodes = messages.select("tree", "node", "parent", "place", F.coalesce("score", F.lit(0.0)).alias("score"))
    above = nodes.select("tree", F.col("node").alias("parent"), F.col("place").alias("_up_place"), F.lit(True).alias("_there"))
    linked = nodes.join(above, ["tree", "parent"], "left")
    parent = F.when(F.col("_there") & (F.col("_up_place") < F.col("place")), F.col("parent"))
    now = cut(linked.select("tree", "node", parent.alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    leaves = now.select("tree", "node").join(now.select("tree", F.col("up").alias("node")).filter("node is not null"), ["tree", "node"], "left_anti")
    jumps, rooted = [], now.filter("up is null")
    now = now.filter("up is not null")
    while now.limit(1).count():
        # only messages that haven't reached their root go on; each jump goes twice as far as the one before
        jumps.append(now.select("tree", "node", "up"))
        ahead = rooted.unionByName(now)
        far = ahead.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        joined = cut(now.join(far, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth")
        ))
        rooted = rooted.unionByName(joined.filter("up is null"))
        now = joined.filter("up is not null")
    now = rooted
    best = Window.partitionBy("tree").orderBy(F.col("_mean").desc(), "node")
    paths = (
        leaves.join(now, ["tree", "node"]).withColumn("_mean", F.col("score") / F.col("depth"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        .select("tree", F.col("node").alias("leaf"), "rank", "depth", "node")
    )
    paths = cut(paths)
    for k in reversed(range(len(jumps))):
        moved = paths.join(jumps[k], ["tree", "node"]).select(
            "tree", "leaf", "rank", (F.col("depth") - 2**k).alias("depth"), F.col("up").alias("node")
        )
        paths = cut(paths.unionByName(moved))  # else each round would work out all earlier ones twice
    return paths


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """tree, rank, n_turns, formatted and loss_spans (0-based code points, end exclusive) of each chosen path."""
    messages = _keyed(messages)
    told = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("said"))
    rows = _paths(messages, top).join(told, ["tree", "node"])
    named = F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"))
    before, after = named, F.lit("")
    for role, (a, b) in WRAPS.items():
        before = F.when(F.col("role") == role, F.lit(a)).otherwise(before)
        after = F.when(F.col("role") == role, F.lit(b)).otherwise(after)
    rows = rows.withColumns({"_a": F.concat(F.lit(OPEN), before), "_z": F.concat(after, F.lit(CLOSE))})
    rows = rows.withColumn("_piece", F.concat("_a", "said", "_z"))
    ahead = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("_piece")).over(ahead), F.lit(0)) + F.char_length("_a")
    rows = rows.withColumn("_from", start).withColumn("_to", F.col("_from") + F.char_length("said"))
    turn = F.struct("depth", "_piece", "role", "_from", "_to")
    whole = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    mask = F.transform(F.filter("_turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["_from"].alias("start"), t["_to"].alias("end")))
    return whole.select(
        F.col("tree.of").alias("tree"), "leaf", "rank", F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"), mask.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Role and text of every turn, read back from a formatted conversation."""
    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.char_length(piece))
        role = F.lit("assistant")
        text = body
        name = F.regexp_extract(body, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        other = body.startswith("[ROLE]")
        role = F.when(other, unescape(name)).otherwise(role)
        text = F.when(other, F.substring(body, F.char_length(name) + len("[ROLE][/ROLE]") + 1, F.char_length(body))).otherwise(text)
        for known, (a, b) in WRAPS.items():
            if a:
                role = F.when(body.startswith(a), F.lit(known)).otherwise(role)
                text = F.when(body.startswith(a), F.substring(body, F.lit(len(a) + 1), F.char_length(body) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p.startswith(OPEN))
    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
