"""Benchmark conversations from nested JSON: one object an entry, sessions under numbered keys, questions beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import time

_SESSION = "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """conv_id (place in the file), conversation (map of raw JSON), qa."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("conv_id", "entry"))
    return raw.select("conv_id", F.from_json(F.get_json_object("entry", "$.conversation"), "map<string,string>").alias("conversation"), F.get_json_object("entry", "$.qa").alias("qa"))


def messages(spark: SparkSession, path: str, sessions: list[int] | None = None) -> DataFrame:
    return messages_of(entries(spark, path), sessions)


def messages_of(entries_: DataFrame, sessions: list[int] | None = None) -> DataFrame:
    """conv_id, session, pos, sender_id, sender_name, content, ts; sessions in the order of their numbers.

    A conversation whose sessions are all filtered out has no rows here but stays in ``entries``.
    """
    pairs = entries_.select("conv_id", F.explode("conversation").alias("k", "v"))
    number = F.regexp_extract("k", r"^session_([0-9]+)$", 1)
    held = pairs.filter(number != "").select("conv_id", number.cast("int").alias("session"), F.from_json("v", _SESSION).alias("m"))
    clock = F.regexp_extract("k", r"^session_([0-9]+)_date_time$", 1)
    times = pairs.filter(clock != "").select("conv_id", clock.cast("int").alias("session"), time.session_clock(F.col("v")).alias("start"))
    if sessions is not None:
        held = held.filter(F.col("session").isin(sessions))
    s = held.join(times, ["conv_id", "session"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    s = s.withColumn("gap", time.spacing_ms(F.size("m"), F.col("start"), F.lead("start").over(Window.partitionBy("conv_id").orderBy("session"))))
    m = s.select("conv_id", "session", "start", "gap", F.posexplode("m").alias("i", "x"))
    content = F.when(F.coalesce("x.blip_caption", F.lit("")) != "", F.concat(F.lit("[Image: "), F.col("x.blip_caption"), F.lit("] "), F.coalesce("x.text", F.lit("")))).otherwise(F.col("x.text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("session", "i")) - 1
    return m.select("conv_id", "session", pos.alias("pos"), F.concat(F.lower("x.speaker"), F.lit("_"), F.col("conv_id").cast("string")).alias("sender_id"), F.col("x.speaker").alias("sender_name"), content.alias("content"), (F.col("start") + F.col("i") * F.col("gap")).cast("bigint").alias("ts"))


def questions(spark: SparkSession, path: str, drop: tuple[int, ...] = (5,)) -> DataFrame:
    return questions_of(entries(spark, path), drop)


def questions_of(entries_: DataFrame, drop: tuple[int, ...] = (5,)) -> DataFrame:
    """conv_id, question_id, question, answer, category; the id keeps a question's place, dropped categories included."""
    qa = entries_.select("conv_id", F.posexplode(F.from_json("qa", "array<struct<question:string,answer:string,category:int>>")).alias("i", "q"))
    return qa.filter(~F.col("q.category").isin(*drop)).select("conv_id", F.concat_ws("_q", F.col("conv_id").cast("string"), F.col("i").cast("string")).alias("question_id"), F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), F.col("q.category").alias("category"))
