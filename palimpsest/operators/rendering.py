"""What a model is shown, as Columns and grouped texts: transcripts, narratives, listings, retrieved documents.

A rendered text belongs to one owner, conversation, cluster or query and is bounded by what a model can read. Lines are put
in order by an explicit place, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text, time

#: What stands where nothing can be shown.
EMPTY_MESSAGE, NONE, NO_RESULTS, NO_LABELS = "[empty message]", "(none)", "No retrieval results", "(none yet)"


def joined(rows: DataFrame, keys: list[str], place: str, line: Column, name: str, separator: str = "\n") -> DataFrame:
    """``keys`` and ``name``: the lines of each key in the order of ``place``; null lines are left out."""
    by = rows.select(*keys, F.col(place).alias("_place"), line.alias("_line")).filter(F.col("_line").isNotNull())
    held = by.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
    return held.select(*keys, F.array_join(F.transform("_lines", lambda x: x["_line"]), separator).alias(name))


def escaped(body: Column) -> Column:
    """Text without markup: the ampersand and angle brackets as entities."""
    return F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def dated_line(ts: Column, who: Column, body: Column) -> Column:
    """One message with its time and weekday; text without a time is an error."""
    at = F.coalesce(time.instant(ts, weekday=True), F.raise_error(F.lit("a chat message with text has no timestamp")).cast("string"))
    return text.chat_line(at, who, body)


def numbered_transcript(items: DataFrame) -> DataFrame:
    """conv_id, transcript: the chat messages numbered from 0, escaped, a line of the time gap between any two.

    Further lines of a message are indented. A message without text keeps its number and needs no time.
    """
    w = Window.partitionBy("conv_id").orderBy("pos")
    chat = items.filter(F.col("kind") == "text").withColumn("_n", F.row_number().over(w) - 1)
    gap = F.concat(F.lit("<time_gap>"), time.gap_label(F.lag("ts").over(w), F.col("ts")), F.lit("</time_gap>\n"))
    line = F.regexp_replace(escaped(dated_line(F.col("ts"), F.col("sender_id"), F.col("content"))), "\n", "\n  ")
    record = F.when(F.coalesce("content", F.lit("")) == "", F.lit(EMPTY_MESSAGE)).otherwise(line)
    chat = chat.withColumn("_gap", F.when(F.col("_n") > 0, gap).otherwise(""))
    return joined(chat, ["conv_id"], "_n", F.concat("_gap", F.lit("["), F.col("_n").cast("string"), F.lit("] "), record), "transcript")


def conversation(items: DataFrame, keys: list[str], tagged: bool = False) -> DataFrame:
    """``keys``, conversation: one line for each chat message with text; ``tagged`` puts the sender's id behind the name."""
    who = text.speaker(F.col("sender_name"), F.col("sender_id")) if "sender_name" in items.columns else F.col("sender_id")
    who = F.concat(who, F.lit("(user_id:"), F.col("sender_id"), F.lit(")")) if tagged else who
    line = F.when(F.col("content") != "", dated_line(F.col("ts"), who, F.col("content")))
    return joined(items.filter((F.col("kind") == "text") & (F.coalesce("content", F.lit("")) != "")), keys, "pos", line, "conversation")


def timeline(episodes: DataFrame, key: str) -> DataFrame:
    """key, timeline: the narratives of a key by time, numbered from 1. episodes: key, ts, ep_id, episode."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("ts", "ep_id"))
    numbered = episodes.withColumn("_n", n)
    return joined(numbered, [key], "_n", F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("episode")), "timeline")


def narratives(episodes: DataFrame, key: str) -> DataFrame:
    """key, narratives: trimmed narratives by time in elements that carry it, closing tags defused."""
    placed = episodes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ts", "ep_id")))
    body = text.defuse_closing_tags(F.regexp_replace("episode", r"^\s+|\s+$", ""))
    return joined(placed, [key], "_n", F.concat(F.lit('<narrative time="'), time.instant(F.col("ts")), F.lit('">'), body, F.lit("</narrative>")), "narratives")


def item_listing(items: DataFrame, xml: bool = True) -> DataFrame:
    """owner_id, bucket, listing: items as JSON with their places. items: owner_id, bucket, pos, description, label, observed_at.

    ``xml`` gives elements in the bucket's own; else lines ``[i] {...}`` under a heading. Null fields stay out.
    """
    shown = F.to_json(F.struct("description", F.col("label"), time.instant(F.col("observed_at")).alias("observed_at")))
    i = F.col("pos").cast("string")
    body = text.defuse_closing_tags(shown)
    line = F.concat(F.lit('<item index="'), i, F.lit('">'), body, F.lit("</item>")) if xml else F.concat(F.lit("["), i, F.lit("] "), body)
    listed = joined(items, ["owner_id", "bucket"], "pos", line, "listing")
    head, foot = (F.concat(F.lit("<"), "bucket", F.lit(">\n")), F.concat(F.lit("\n</"), "bucket", F.lit(">"))) if xml else (F.concat(F.lit("=== "), "bucket", F.lit(" ===\n")), F.lit(""))
    return listed.select("owner_id", "bucket", F.concat(head, "listing", foot).alias("listing"))


def label_inventory(items: DataFrame) -> DataFrame:
    """owner_id, bucket, labels: the distinct labels in use, trimmed, in the order in which they were first used."""
    used = items.select("owner_id", "bucket", "pos", F.trim(F.coalesce("label", F.lit(""))).alias("label"))
    first = used.filter(F.col("label") != "").groupBy("owner_id", "bucket", "label").agg(F.min("pos").alias("pos"))
    every = items.select("owner_id", "bucket").distinct()
    listed = joined(first, ["owner_id", "bucket"], "pos", F.col("label"), "labels", ", ")
    return every.join(listed, ["owner_id", "bucket"], "left").select("owner_id", "bucket", F.coalesce("labels", F.lit(NO_LABELS)).alias("labels"))


def matter_listing(matters: DataFrame, dated: bool = True) -> DataFrame:
    """owner_id, listing: topics not to be recorded with what is excepted from them. matters: owner_id, pos, topic, observed_at, exceptions."""
    since = F.when(F.coalesce("observed_at", F.lit(0)) != 0, F.concat(F.lit(' since="'), time.instant(F.col("observed_at")), F.lit('"'))).otherwise("") if dated else F.lit("")
    parts = F.array_join(F.transform(F.coalesce("exceptions", F.array()), lambda e: F.concat(F.lit("<except>"), text.defuse_closing_tags(e), F.lit("</except>"))), "")
    line = F.concat(F.lit('<matter index="'), F.col("pos").cast("string"), F.lit('"'), since, F.lit(">"), text.defuse_closing_tags(F.col("topic")), parts, F.lit("</matter>"))
    return joined(matters, ["owner_id"], "pos", line, "listing")


def pending_listing(pending: DataFrame) -> DataFrame:
    """owner_id, listing: held patterns with the day they were first seen. pending: owner_id, pos, description, category, evidence, observed_at."""
    shown = text.defuse_closing_tags(F.to_json(F.struct("description", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("evidence", F.lit("")).alias("evidence"))))
    line = F.concat(F.lit('<entry index="'), F.col("pos").cast("string"), F.lit('" first_seen="'), time.day(F.col("observed_at")), F.lit('">'), shown, F.lit("</entry>"))
    return joined(pending, ["owner_id"], "pos", line, "listing")


def retrieved_documents(hits: DataFrame, head: int = 500) -> DataFrame:
    """query_id, documents: hits in order with title, date and the first ``head`` characters. hits: query_id, rank, subject, content, ts.

    A hit without content is an error of its own relation (``blank_documents``), never shown.
    """
    title = F.when(F.coalesce("subject", F.lit("")) != "", F.col("subject")).otherwise("N/A")
    date = F.coalesce(F.when(F.col("ts") > 0, time.instant(F.col("ts"))), F.lit("N/A"))
    body = F.when(F.length("content") > head, F.concat(F.substring("content", 1, head), F.lit("..."))).otherwise(F.col("content"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("string")
    held = hits.filter(F.coalesce("content", F.lit("")) != "").withColumn("_n", n)
    line = F.concat(F.lit("Document "), F.col("_n"), F.lit(":\n  Title: "), title, F.lit("\n  Date: "), date, F.lit("\n  Content: "), body, F.lit("\n"))
    shown = joined(held, ["query_id"], "rank", line, "documents")
    return hits.select("query_id").distinct().join(shown, "query_id", "left").select("query_id", F.coalesce("documents", F.lit(NO_RESULTS)).alias("documents"))


def blank_documents(hits: DataFrame) -> DataFrame:
    """query_id, id, rule of hits that have no text to be ranked or shown by."""
    return hits.filter(F.coalesce(F.trim("content"), F.lit("")) == "").select("query_id", "id", F.lit("content: blank").alias("rule"))


def rerank_inputs(hits: DataFrame) -> DataFrame:
    """query_id, rank, id, text: trimmed texts of hits that have one."""
    return hits.withColumn("text", F.regexp_replace("content", r"^\s+|\s+$", "")).filter(F.coalesce("text", F.lit("")) != "").select("query_id", "rank", "id", "text")


def answer_context(members: DataFrame, episodes: DataFrame, speakers: DataFrame, top: int) -> DataFrame:
    """question_id, context: the first ``top`` members that are known episodes, in their order, under both speakers' names.

    members: question_id, conv_id, place (from 0), ep_id; episodes: conv_id, ep_id, subject, episode; speakers: conv_id, speaker_a, speaker_b.
    """
    held = members.filter(F.col("place") < top).join(episodes, ["conv_id", "ep_id"])
    line = F.concat(F.coalesce("subject", F.lit("N/A")), F.lit(": "), F.coalesce("episode", F.lit("N/A")), F.lit("\n---"))
    shown = joined(held, ["question_id"], "place", line, "episodes", "\n\n")
    asked = members.select("question_id", "conv_id").distinct().join(shown, "question_id", "left").join(speakers, "conv_id", "left")
    names = [F.coalesce("speaker_a", F.lit("A")), F.coalesce("speaker_b", F.lit("B"))]
    return asked.select("question_id", names[0].alias("speaker_a"), names[1].alias("speaker_b"), F.coalesce("episodes", F.lit("")).alias("episodes"))


def case_prompt(cases: DataFrame) -> DataFrame:
    """case_id, prompt: a case as JSON; an insight only where there is one. cases: case_id, ts, task_intent, approach, quality_score, key_insight."""
    insight = F.when(F.coalesce("key_insight", F.lit("")) != "", F.col("key_insight"))
    shown = F.struct(F.col("ts").alias("timestamp"), F.coalesce("task_intent", F.lit("")).alias("task_intent"), F.coalesce("approach", F.lit("")).alias("approach"), "quality_score", insight.alias("key_insight"))
    return cases.select("case_id", F.to_json(shown).alias("prompt"))


def data_uri(content: Column, mime: Column) -> Column:
    """File bytes as a data URI."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\r?\n", ""))
