"""What models extract, as requests and as finished relations.

Each kind has a reply shape (``replies.SHAPES``, read strictly) and a finish that turns good replies into rows; replies that are missing or
break the shape are rows of an error relation (key, rule) instead. Requests are made by ``model.requests`` and answered
outside; nothing here depends on which model did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text, time
from palimpsest.operators import model
from palimpsest.operators import replies as replies_
from palimpsest.operators.scoring import case_gate
from palimpsest.session import plain_union

def read(asked: DataFrame, replies: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(requests with ``value``, the good reply as JSON; request_hash and rule of the others)."""
    parsed = replies_.parsed(model.replied(asked, replies), kind)
    ok = parsed.filter(F.col("parsed.ok") & F.col("error").isNull()).withColumn("value", F.col("parsed.value")).drop("parsed", "reply", "error")
    bad = parsed.filter(~(F.col("parsed.ok") & F.col("error").isNull())).select("request_hash", F.coalesce("error", F.col("parsed.error")).alias("rule"))
    return ok, bad


def _field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("value", f"$.{name}").cast(kind)


def _list(name: str, kind: str) -> Column:
    return F.from_json(F.get_json_object("value", f"$.{name}"), f"array<{kind}>")


def boundaries(good: DataFrame) -> DataFrame:
    """conv_id, cut: distinct indices of each reply inside the conversation. good: conv_id, n, value."""
    return model.boundary_replies(good.select(F.col("conv_id").alias("key"), "n", _list("boundaries", "int").alias("indices"))).withColumnRenamed("key", "conv_id")


def episodes(good: DataFrame, head: int = 200) -> tuple[DataFrame, DataFrame]:
    """(cell_id, ts, subject, episode, summary; cell_id and rule): blank titles or contents are errors; the summary is the start."""
    e = good.select("cell_id", "ts", F.trim(_field("title")).alias("subject"), F.trim(_field("content")).alias("episode"))
    blank = (F.col("subject") == "") | (F.col("episode") == "")
    rule = F.when(F.col("subject") == "", "title: blank").otherwise("content: blank")
    return e.filter(~blank).withColumn("summary", F.substring("episode", 1, head)), e.filter(blank).select("cell_id", rule.alias("rule"))


def summaries(good: DataFrame) -> DataFrame:
    """cell_id, summary: capped by width at a sentence's end."""
    return good.select("cell_id", text.summary(F.trim(_field("summary"))).alias("summary"))


def facts(good: DataFrame) -> DataFrame:
    """ep_id, fact_no, content: trimmed, not blank, in order."""
    f = good.select("ep_id", F.posexplode(_list("atomic_facts.atomic_fact", "string")).alias("i", "c")).select("ep_id", "i", F.trim("c").alias("content")).filter(F.col("content") != "")
    return f.select("ep_id", (F.row_number().over(Window.partitionBy("ep_id").orderBy("i")) - 1).alias("fact_no"), "content")


def foresights(good: DataFrame, most: int = 10) -> DataFrame:
    """cell_id, n, foresight, start_time, end_time, duration_days: the first ``most`` that are not blank.

    The start is the reply's date or the cell's day; the end follows from the length, or the length from the end.
    """
    kind = "struct<content:string,start_time:string,end_time:string,duration_days:int>"
    f = good.select("cell_id", "ts", F.posexplode(_list("foresights", kind)).alias("i", "f")).filter(F.trim(F.coalesce("f.content", F.lit(""))) != "")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("cell_id").orderBy("i"))).filter(F.col("n") <= most)
    start = F.coalesce(time.cleaned_date(F.col("f.start_time")), time.day(F.col("ts")))
    end = time.cleaned_date(F.col("f.end_time"))
    f = f.select("cell_id", "n", F.trim("f.content").alias("foresight"), start.alias("start_time"), end.alias("e"), F.col("f.duration_days").alias("d"))
    return f.select("cell_id", "n", "foresight", "start_time", F.coalesce("e", time.plus_days(F.col("start_time"), F.col("d"))).alias("end_time"), F.coalesce("d", time.days_between(F.col("start_time"), F.col("e"))).alias("duration_days"))


def assigned_clusters(good: DataFrame, recall: DataFrame, sure: float = 0.85) -> DataFrame:
    """id, cluster_id: the nearest recalled cluster where it is sure, else the one that the reply names; null opens a new one.

    recall: id, place (from 0), cluster_id, similarity. An index outside the list opens a new cluster.
    """
    near = recall.filter((F.col("place") == 0) & (F.col("similarity") >= sure)).select("id", F.col("cluster_id").alias("near"))
    named = good.select("id", _field("idx", "int").alias("place")).join(recall.select("id", "place", F.col("cluster_id").alias("named")), ["id", "place"], "left").select("id", "named")
    return recall.select("id").distinct().join(near, "id", "left").join(named, "id", "left").select("id", F.coalesce("near", "named").alias("cluster_id"))


def reranked(good: DataFrame) -> DataFrame:
    """query_id, id, score: the reply's scores, the last one of an id."""
    r = good.select("query_id", F.posexplode(_list("ranked", "struct<id:string,score:double>")).alias("i", "r")).filter("r.id is not null and r.score is not null")
    return r.groupBy("query_id", F.col("r.id").cast("bigint").alias("id")).agg(F.max_by("r.score", "i").alias("score"))


def batch_scores(batches: DataFrame, least: float = 0.3) -> DataFrame:
    """query_id, id, score of queries of whose rerank batches a share of ``least`` at least came back.

    batches: query_id, batch, ok, scores array<struct<id, score>>.
    """
    share = F.avg(F.col("ok").cast("double")).over(Window.partitionBy("query_id"))
    return batches.withColumn("_s", share).filter((F.col("_s") >= least) & F.col("ok")).select("query_id", F.explode("scores").alias("x")).select("query_id", "x.id", "x.score")


def verdicts(good: DataFrame) -> DataFrame:
    return good.select("query_id", _field("is_sufficient", "boolean").alias("sufficient"))


def further_queries(good: DataFrame, original: Column, count: int = 3) -> DataFrame:
    """query_id, n, query: the usable ones of the reply."""
    return good.select("query_id", F.posexplode(text.usable_queries(_list("queries", "string"), original, count)).alias("n", "query"))


def gated(good: DataFrame, tokens: Column, bypass: int = 50_000, least: float = 0.7) -> DataFrame:
    return good.select("case_id", case_gate(tokens, text.clamp(_field("probability", "double")), bypass, least).alias("admitted"))


def categories(good: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, category_id: a label of the closed set ``known`` (id), '' for any other."""
    c = good.select("doc_id", F.trim(_field("category_id")).alias("id"))
    return c.join(known.select("id", F.lit(True).alias("_k")).distinct(), "id", "left").select("doc_id", F.when(F.col("_k"), F.col("id")).otherwise("").alias("category_id"))


def reflected(episodes_: DataFrame, merged: DataFrame) -> DataFrame:
    """Episodes after reflection: clusters of two or more become their merged row, all others pass.

    episodes_: ep_id, cluster_id, ts, episode, memcell_ids; merged: cluster_id, episode (of good replies).
    """
    sized = episodes_.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))).join(merged.select("cluster_id", F.col("episode").alias("_m")), "cluster_id", "left")
    joins = (F.col("_n") >= 2) & F.col("_m").isNotNull() & F.col("cluster_id").isNotNull()
    one = sized.filter(joins).groupBy("cluster_id").agg(F.max("ts").alias("ts"), F.first("_m").alias("episode"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("memcell_ids")))).alias("memcell_ids"))
    rest = sized.filter(~joins).select("cluster_id", "ts", "episode", "memcell_ids")
    return plain_union(one.select("cluster_id", "ts", "episode", "memcell_ids"), rest)
