"""Calls to models as relations: requests out, replies in.

An operator that needs a model makes a request table (request_hash, operator, messages); replies come back as a table
(request_hash, reply, error) from whatever service the caller runs, and are joined by hash. Nothing calls a model inside
a plan, so a plan can be run again on the same replies.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def requests(df: DataFrame, operator: str, system, user) -> DataFrame:
    """df with request_hash and messages: one system and one user message from two Columns. Equal requests share a hash."""
    out = df.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).cast(MESSAGES))
    return out.withColumn("operator", F.lit(operator)).withColumn("request_hash", F.sha2(F.concat_ws("\x1f", F.lit(operator), F.to_json("messages")), 256))


def pending_requests(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """The distinct requests that have no reply yet."""
    return asked.select("request_hash", "operator", "messages").dropDuplicates(["request_hash"]).join(replies.select("request_hash").distinct(), "request_hash", "left_anti")


def replied(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests with reply and error; a request without a reply has neither."""
    one = replies.groupBy("request_hash").agg(F.min(F.struct("reply", "error")).alias("r"))
    return asked.join(one, "request_hash", "left").withColumn("reply", F.col("r.reply")).withColumn("error", F.col("r.error")).drop("r")


#: Kinds of reply fields and the JSON values that they take, without coercion.
KINDS = {"string": (str,), "bool": (bool,), "int": (int,), "number": (int, float), "list": (list,), "object": (dict,)}


def check_reply(reply: str | None, fields: dict[str, str], optional: frozenset[str] = frozenset()) -> tuple[bool, str, str | None]:
    """(ok, error, value as JSON): the reply must be an object with exactly these fields, each of its kind.

    A fence of three backticks around the object is accepted. Errors name the field and rule, never the content.
    """
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[1] if "\n" in text else ""
        text = text.rsplit("```", 1)[0]
    try:
        value = json.loads(text)
    except ValueError:
        return False, "reply: not JSON", None
    if not isinstance(value, dict):
        return False, "reply: not an object", None
    for name in value:
        if name not in fields:
            return False, f"{name}: unknown field", None
    for name, kind in fields.items():
        if name not in value:
            if name in optional:
                continue
            return False, f"{name}: missing", None
        ok = isinstance(value[name], KINDS[kind]) and (kind == "bool" or not isinstance(value[name], bool))
        if not ok:
            return False, f"{name}: not of kind {kind}", None
    return True, "", json.dumps(value, sort_keys=True)


def parse_replies(df: DataFrame, fields: dict[str, str], optional: frozenset[str] = frozenset()) -> DataFrame:
    """Add ``parsed``: struct<ok, error, value>."""

    @F.pandas_udf("struct<ok:boolean,error:string,value:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check_reply(x, fields, optional) for x in s], columns=["ok", "error", "value"])

    return df.withColumn("parsed", run("reply"))


def boundary_replies(df: DataFrame) -> DataFrame:
    """(key, cut): of the indices of each reply those inside 1..n-1, distinct. df: key, n, indices array<int>."""
    return df.select("key", "n", F.explode(F.array_distinct("indices")).alias("cut")).filter((F.col("cut") >= 1) & (F.col("cut") < F.col("n"))).select("key", "cut")


def token_usage(df: DataFrame, count) -> DataFrame:
    """Prompt and completion tokens by operator; ``count`` makes a token Column of a text Column."""
    prompt = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    return df.withColumn("_p", count(prompt)).withColumn("_c", count(F.coalesce("reply", F.lit("")))).groupBy("operator").agg(F.count(F.lit(1)).alias("calls"), F.sum("_p").alias("prompt_tokens"), F.sum("_c").alias("completion_tokens"))


def cost(usage: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Add the cost at prices for a million tokens."""
    return usage.withColumn("cost", F.round((F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price) / 1e6, 6))
