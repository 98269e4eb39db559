"""Reply trees to training conversations, with DataFrame operations only.

Every message names the one it answers. Root-to-leaf paths are found by self-joins that double
their reach each round; branches are ranked by score, and each chosen path becomes one text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.tables import stage

START, BODY, END = "<|start|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """No control string can stand in an escaped text: all begin with ``<``."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def threads(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """A plain table of turns as a reply tree: every turn answers the one before. Turns with one
    number are ordered by role and text, a null turn comes first; nulls in role or text count as
    empty, rows without a conversation are left out, other columns are ignored."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select("conv", at.alias("id"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, distance, id) for every message on the way from each leaf to its root.

    A parent that is null or missing makes a root. Each round joins the paths so far with
    ancestors twice as far away, so a depth of d takes log2(d) rounds. Cyclic replies raise, before
    any path is extended.
    """
    nodes = messages.select("conv", "id", "parent")
    links = nodes.join(nodes.select("conv", F.col("id").alias("parent")).distinct(), ["conv", "parent"])
    jump = stage(links.select("conv", "id", F.col("parent").alias("up")).distinct(), "chat-links")
    leaves = nodes.select("conv", "id").distinct().join(jump.select("conv", F.col("up").alias("id")), ["conv", "id"], "left_anti")
    found = stage(leaves.select("conv", F.col("id").alias("leaf"), F.lit(0).cast("long").alias("distance"), "id"), "chat-paths")
    # a path visits no message of its conversation twice, so jumps over all of them only go round
    most = nodes.groupBy("conv").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = [jump]
    while not jumps[-1].isEmpty():
        if len(jumps) > most.bit_length():
            raise ValueError("the replies form a cycle")
        again = jumps[-1].select("conv", F.col("id").alias("up"), F.col("up").alias("top"))
        jumps.append(stage(jumps[-1].join(again, ["conv", "up"]).select("conv", "id", F.col("top").alias("up")), "chat-links"))
    reach = 1
    for jump in jumps[:-1]:
        further = found.join(jump, ["conv", "id"]).select("conv", "leaf", (F.col("distance") + reach).alias("distance"), F.col("up").alias("id"))
        found = stage(found.union(further), "chat-paths")
        reach *= 2
    return found


def format_paths(messages: DataFrame, *, branches: int = 1, learn_role: str = "assistant") -> DataFrame:
    """One row per chosen path: conv, leaf, rank, score, n_turns, formatted, loss.

    ``messages`` has conv, id, parent, role, text, score. Paths of a conversation are ranked by
    total score, then by the smaller leaf; the best ``branches`` are kept. ``formatted`` marks
    every turn and escapes texts; ``loss`` has, per turn, start and length (code points of
    ``formatted``) of what is to be learnt: the text if the role is ``learn_role``, else length 0.
    An empty table gives no rows; a repeated message (same conv and id) counts once, the smallest.
    """
    messages = stage(messages.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
                     .select("conv", "id", "m.*"), "chat-messages")
    all_paths = paths(messages)
    scored = all_paths.join(messages.select("conv", "id", F.coalesce("score", F.lit(0.0)).alias("score")), ["conv", "id"])
    total = scored.groupBy("conv", "leaf").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    chosen = total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    turns = all_paths.join(chosen, ["conv", "leaf"]).join(messages.drop("score", "parent"), ["conv", "id"])
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    turns = turns.select("conv", "leaf", "rank", "score", "distance", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"),
                         F.coalesce(F.col("role") == learn_role, F.lit(False)).alias("learn"))
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    turns = turns.select("conv", "leaf", "rank", "score", "distance", F.concat("head", "body", F.lit(END)).alias("piece"),
                         F.struct(start.cast("long").alias("start"), F.when(F.col("learn"), F.length("body")).otherwise(0).alias("length")).alias("span"))
    rows = turns.groupBy("conv", "leaf", "rank", "score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "piece", "span"))).alias("t"))
    return rows.select("conv", "leaf", "rank", "score", F.size("t").cast("long").alias("n_turns"),
                       F.array_join(F.col("t.piece"), "").alias("formatted"), F.col("t.span").alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv, leaf, at, role, text, learnt) from the formatted texts and their loss spans alone.
    ``learnt`` is the unescaped text under the mask."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>", -1), F.lit(1), F.col("n_turns").cast("int"))
    rows = formatted.select("conv", "leaf", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss"))).alias("at", "t"))
    rows = rows.select("conv", "leaf", "at", F.col("t.piece").alias("piece"), F.col("t.loss").alias("span"))
    before = Window.partitionBy("conv", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("piece") + len(END)).over(before), F.lit(0))
    rows = rows.withColumn("offset", offset)
    parts = F.split("piece", r"<\|text\|>", 2)
    return rows.select(
        "conv", "leaf", "at", unescape(F.substring(parts[0], F.lit(len(START) + 1), F.length(parts[0]))).alias("role"),
        unescape(parts[1]).alias("text"),
        unescape(F.substring("piece", (F.col("span.start") - F.col("offset") + 1).cast("int"), F.col("span.length"))).alias("learnt"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`read_turns` reads back, one row per formatted text."""
    turns = read_turns(formatted).groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "learnt"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.col("t.learnt"), "")
    turns = turns.select("conv", "leaf", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                         F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"))
    sizes = formatted.select("conv", "leaf", F.length("formatted").cast("long").alias("formatted_chars"))
    return turns.join(sizes, ["conv", "leaf"])
