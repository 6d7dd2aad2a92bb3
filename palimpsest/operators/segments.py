"""Conversations as rows: chat views, cuts and segments, tool-call groups, structural gates.

Items are (conv_id, pos, kind, role, content, ts, ...); kind is text, tool_call or tool_result. Everything is windows and
aggregates over a conversation; only what truly walks is a function of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGES, TOKENS = 500, 65_536


def _by(*keys: str):
    return Window.partitionBy("conv_id").orderBy(*(keys or ("pos",)))


def chat_view(items: DataFrame) -> DataFrame:
    """Chat items with their ordinal (from 0) among the chat items of their conversation."""
    return items.filter(F.col("kind") == "text").withColumn("chat_pos", (F.row_number().over(_by()) - 1).cast("bigint"))


def spoken(items: DataFrame) -> DataFrame:
    return items.filter(F.col("role").isin("user", "assistant"))


def from_first_user(items: DataFrame) -> DataFrame:
    """Items from the first user message on; none if there is no such message."""
    first = F.min(F.when(F.col("role") == "user", F.col("pos"))).over(Window.partitionBy("conv_id"))
    return items.withColumn("_first", first).filter(F.col("pos") >= F.col("_first")).drop("_first")


def item_cuts(cuts: DataFrame, items: DataFrame) -> DataFrame:
    """conv_id, end_pos: chat ordinals of cuts to item positions; a cut past the last chat item is the number of items."""
    chat = chat_view(items).select("conv_id", F.col("chat_pos").alias("cut"), F.col("pos").alias("at"))
    size = items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_items"))
    return cuts.join(chat, ["conv_id", "cut"], "left").join(size, "conv_id").select("conv_id", "cut", F.coalesce("at", "n_items").alias("end_pos"))


def segments(items: DataFrame, cuts: DataFrame) -> DataFrame:
    """Items with segment_id: the number of cuts (conv_id, end_pos) at or before their position."""
    marks = cuts.select("conv_id", F.col("end_pos").alias("pos")).distinct().withColumn("_cut", F.lit(1))
    marked = items.join(marks, ["conv_id", "pos"], "left")
    return marked.withColumn("segment_id", F.sum(F.coalesce("_cut", F.lit(0))).over(_by().rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_cut")


def cells(segmented: DataFrame) -> DataFrame:
    """conv_id, segment_id, start_pos, end_pos, n_items, ts: a cell's time is that of its last chat message."""
    last = F.max_by(F.when(F.col("kind") == "text", F.col("ts")), F.when(F.col("kind") == "text", F.col("pos")))
    return segmented.groupBy("conv_id", "segment_id").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.count(F.lit(1)).alias("n_items"), last.alias("ts"))


def cell_errors(cells_: DataFrame) -> DataFrame:
    """Cells that break an invariant, with the rule: a cell needs items and a chat message."""
    rule = F.when(F.col("n_items") < 1, "empty").when(F.col("ts").isNull(), "no chat message")
    return cells_.withColumn("rule", rule).filter(F.col("rule").isNotNull()).select("conv_id", "segment_id", "rule")


def force_cuts_by_count(sizes: DataFrame, limit: int = MESSAGES) -> DataFrame:
    """conv_id, cut: while ``limit`` messages or more are left, cut after limit - 1 (after n - 1 where fewer are). n is ``n``."""
    step = limit - 1
    k = F.when(F.col("n") >= limit, F.floor((F.col("n") - limit) / step) + 1).otherwise(F.lit(0).cast("bigint"))
    return sizes.withColumn("_k", k).filter("_k > 0").select("conv_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "_k")).alias("_i")).select("conv_id", (F.col("_i") * step).alias("cut"))


def force_cuts(items: DataFrame, message_limit: int = MESSAGES, token_limit: int = TOKENS) -> DataFrame:
    """conv_id, cut for conversations over a message or token limit. items: conv_id, pos, n_tokens.

    While more than one message is left and a limit is reached: take limit - 1 messages (or all but one), halve while
    their tokens reach the limit, one at least, and cut there. A walk, so a function of the group.
    """

    def run(key, frame):
        import numpy as np
        import pandas as pd

        total = np.concatenate([[0], np.cumsum(frame.sort_values("pos")["n_tokens"].to_numpy())])
        at, n, out = 0, len(total) - 1, []
        while n - at > 1 and (total[n] - total[at] >= token_limit or n - at >= message_limit):
            c = min(message_limit - 1, n - at - 1)
            while c > 1 and total[at + c] - total[at] >= token_limit:
                c = max(1, c // 2)
            at += c
            out.append(at)
        return pd.DataFrame({"conv_id": key[0], "cut": out}, index=range(len(out)))

    return items.select("conv_id", "pos", "n_tokens").groupBy("conv_id").applyInPandas(run, "conv_id bigint, cut bigint")


def batch_cuts(items: DataFrame, replies: DataFrame, limit: int = MESSAGES, final: bool = False) -> DataFrame:
    """conv_id, cut (over chat messages): cuts forced by the number of messages, then a model's cuts inside what is left.

    replies: conv_id, cut, counted from the first message that no forced cut closed; only cuts inside the rest count.
    ``final`` closes the tail as well.
    """
    from palimpsest.session import plain_union

    sizes = chat_view(items).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    forced = force_cuts_by_count(sizes, limit)
    rest = sizes.join(forced.groupBy("conv_id").agg(F.max("cut").alias("start")), "conv_id", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    named = replies.select("conv_id", F.col("cut").alias("_c")).join(rest, "conv_id").filter((F.col("_c") >= 1) & (F.col("_c") < F.col("n") - F.col("start")))
    kept = [forced.select("conv_id", "cut"), named.select("conv_id", (F.col("start") + F.col("_c")).alias("cut"))]
    if final:
        kept.append(sizes.select("conv_id", F.col("n").alias("cut")))
    return plain_union(*[k.select("conv_id", F.col("cut").cast("bigint").alias("cut")) for k in kept]).distinct()


def step_errors(items: DataFrame) -> DataFrame:
    """conv_id, pos, rule of what the step path can't judge: items that are no chat messages, and text without a time."""
    rule = F.when(F.col("kind") != "text", "not a chat message").when((F.coalesce("content", F.lit("")) != "") & (F.coalesce("ts", F.lit(0)) == 0), "no timestamp")
    return items.select("conv_id", "pos", rule.alias("rule")).filter("rule is not null")


def tool_groups(items: DataFrame) -> DataFrame:
    """conv_id, start_pos, end_pos, n_results: each tool call with the results right after it."""
    new = (F.col("kind") != "tool_result") | (F.lag("kind").over(_by()).isin("text") | F.lag("kind").over(_by()).isNull())
    marked = items.withColumn("_g", F.sum(new.cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    by = marked.groupBy("conv_id", "_g").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"), F.count_if(F.col("kind") == "tool_result").alias("n_results"), F.min_by("kind", "pos").alias("head"))
    return by.filter(F.col("head") == "tool_call").select("conv_id", "start_pos", "end_pos", "n_results")


def skip_reasons(items: DataFrame, least_users: int = 2, least_messages: int = 5, least_tokens: int = 200) -> DataFrame:
    """conv_id, reason, detail: the first structural reason not to learn from a trajectory, null for none. items also has n_tokens.

    Only items from the first user message on count. The last one must be an assistant's message: a trajectory that ends in
    a call, a result or a user's turn is not closed. One without tools needs enough user turns, items and assistant tokens.
    ``detail`` is the value that missed.
    """
    first = F.min(F.when((F.col("kind") == "text") & (F.col("role") == "user"), F.col("pos"))).over(Window.partitionBy("conv_id"))
    chat, inside = F.col("kind") == "text", F.coalesce(F.col("pos") >= F.col("_first"), F.lit(False))
    spoke = chat & (F.col("role") == "assistant")
    label = F.when(chat, F.concat(F.lit("text:"), F.coalesce("role", F.lit("")))).otherwise(F.col("kind"))
    by = items.withColumn("_first", first).groupBy("conv_id").agg(
        F.count_if(inside).alias("n"),
        F.bool_or(inside & ~chat).alias("tools"),
        F.bool_or(inside & (spoke | (F.col("kind") == "tool_call"))).alias("answered"),
        F.max_by(label, F.when(inside, F.col("pos"))).alias("last"),
        F.count_if(inside & chat & (F.col("role") == "user")).alias("users"),
        F.sum(F.when(inside & spoke, F.col("n_tokens")).otherwise(0)).alias("tokens"),
    )
    reason = (
        F.when(F.col("n") == 0, "no_messages_after_strip")
        .when(~F.col("answered"), "no_assistant_message")
        .when(F.col("last") != "text:assistant", "trajectory_not_closed")
        .when(~F.col("tools") & (F.col("users") < least_users), "no_tool_single_user")
        .when(~F.col("tools") & (F.col("n") < least_messages), "no_tool_too_few_messages")
        .when(~F.col("tools") & (F.col("tokens") < least_tokens), "no_tool_assistant_too_short")
    )
    detail = F.when(reason == "trajectory_not_closed", F.col("last")).when(reason == "no_tool_single_user", F.col("users").cast("string"))
    detail = detail.when(reason == "no_tool_too_few_messages", F.col("n").cast("string")).when(reason == "no_tool_assistant_too_short", F.col("tokens").cast("string"))
    return by.select("conv_id", reason.alias("reason"), detail.alias("detail"))


def greedy_batches(items: DataFrame, budget: int) -> DataFrame:
    """key, pos, batch: items of a key in order, a new batch whenever the budget would be exceeded. items: key, pos, size."""

    def run(key, frame):
        frame = frame.sort_values("pos")
        held, number, out = 0, 0, []
        for size in frame["size"].tolist():
            if held and held + size > budget:
                number, held = number + 1, 0
            held += size
            out.append(number)
        return frame[["key", "pos"]].assign(batch=out)

    return items.select("key", "pos", "size").groupBy("key").applyInPandas(run, "key bigint, pos bigint, batch bigint")
