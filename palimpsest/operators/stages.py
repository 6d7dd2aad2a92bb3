"""A benchmark's stages as relations: what is indexed, searched, answered, scored and reported.

Everything is keyed by conversation or question, so one plan covers all of them; what fails is a row of an error relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import stems
from palimpsest.operators import retrieve
from palimpsest.session import plain_union


def numeric_order(ids: Column) -> tuple[Column, Column]:
    """(prefix, number): ids that end in _digits sort by their number, others by themselves."""
    has = ids.rlike("^.*_[0-9]+$")
    return F.when(has, F.regexp_extract(ids, "^(.*)_([0-9]+)$", 1)).otherwise(ids), F.when(has, F.regexp_extract(ids, "^(.*)_([0-9]+)$", 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def chosen_conversations(convs: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """conv_id, place: conversations in the order of their numbers, from 0; only the places ``wanted``. convs: conv_id string."""
    prefix, number = numeric_order(F.col("conv_id"))
    # one short row a conversation
    placed = convs.select("conv_id", (F.row_number().over(Window.orderBy(prefix, number, "conv_id")) - 1).cast("bigint").alias("place"))
    return placed if wanted is None else placed.filter(F.col("place").isin(wanted))


def human_senders(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, sender_id, name: senders of users' messages, and the first name of theirs that is not blank, trimmed; else the id."""
    chat = items.filter(F.col("kind") == "text")
    named = F.when(F.coalesce(F.trim("sender_name"), F.lit("")) != "", F.col("pos"))
    by = chat.groupBy(*keys, "sender_id").agg(F.bool_or(F.col("role") == "user").alias("_u"), F.min_by(F.trim("sender_name"), named).alias("_n"), F.min(named).alias("_p"))
    return by.filter("_u").select(*keys, "sender_id", F.when(F.col("_p").isNotNull(), F.col("_n")).otherwise(F.col("sender_id")).alias("name"))


def owner_episodes(episodes: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(owner_id, ep_id, place: narratives that name the owner, by time; owner_id, rule of batches without any).

    episodes: owner_id, ep_id, ts, episode, and what ``owner`` reads. Names meet texts with white space and case folded.
    """
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    blank = F.coalesce(F.trim("episode"), F.lit("")) == ""
    seen = episodes.withColumn("_blank", blank).withColumn("_in", ~blank & F.contains(folded(F.col("episode")), folded(owner)))
    kept = seen.filter("_in").select("owner_id", "ep_id", (F.row_number().over(Window.partitionBy("owner_id").orderBy("ts", "ep_id")) - 1).cast("bigint").alias("place"))
    by = seen.groupBy("owner_id").agg(F.bool_or("_blank").alias("_b"), F.bool_or("_in").alias("_i"))
    rule = F.when(F.col("_b"), "episode: blank").when(~F.col("_i"), "owner: not named")
    return kept, by.select("owner_id", rule.alias("rule")).filter("rule is not null")


def facts_of(facts: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ep_id, n_facts, contents in order; ep_id of episodes without a fact, which can't be indexed)."""
    by = facts.groupBy("ep_id").agg(F.count(F.lit(1)).alias("n_facts"), F.sort_array(F.collect_list(F.struct("fact_no", "content"))).alias("_f"))
    held = episodes.select("ep_id").join(by, "ep_id", "left")
    return held.filter("n_facts > 0").select("ep_id", "n_facts", F.transform("_f", lambda x: x["content"]).alias("contents")), held.filter("n_facts is null").select("ep_id")


def embedding_units(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """ep_id, kind, n, vec, searched: an episode's vectors of facts, subject and body; the body is kept but not searched.

    episodes: ep_id, subject_vec, episode_vec; facts: ep_id, fact_no, vec. Null vectors, and empty ones of facts, are absent.
    """
    f = facts.filter(F.col("vec").isNotNull() & (F.size("vec") > 0)).select("ep_id", F.lit("fact").alias("kind"), F.col("fact_no").cast("int").alias("n"), "vec")
    one = lambda c, kind: episodes.filter(F.col(c).isNotNull()).select("ep_id", F.lit(kind).alias("kind"), F.lit(0).alias("n"), F.col(c).alias("vec"))
    return plain_union(f, one("subject_vec", "subject"), one("episode_vec", "episode")).withColumn("searched", F.col("kind") != "episode")


def index(units: DataFrame, vectors: DataFrame, clusters: DataFrame, stem: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, vectors, clusters) of all conversations at once, as a search reads them.

    units: conv_id, ep_id, n, text (searchable texts of an episode); vectors: conv_id, ep_id, kind, n, vec (``embedding_units``);
    clusters: conv_id, cluster_id, members. Postings are counted by unit, so that an episode can score by its best one;
    units without a word have none, vectors that are not searched are left out, as are members that are no episode.
    """
    keyed = units.select(F.struct("conv_id", "ep_id", "n").alias("unit"), "text")
    postings = stems.terms(keyed, "unit", stem).select("unit.conv_id", "unit.ep_id", "unit.n", "term", "tf")
    searched = vectors.filter(F.col("kind") != "episode").select("conv_id", "ep_id", "n", "vec")
    known = units.select("conv_id", "ep_id").distinct()
    members = clusters.select("conv_id", "cluster_id", F.explode("members").alias("ep_id")).join(known, ["conv_id", "ep_id"], "left_semi")
    return postings, searched, members


def cluster_rows(assigned: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster_id, count, last_ts, members, preview: clusters as they are searched; members by arrival, the last five as preview.

    assigned: cluster_id, id; vectors: id, ts.
    """
    by = assigned.join(vectors.select("id", "ts"), "id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_list(F.struct("ts", "id"))).alias("_m"))
    ids = F.transform("_m", lambda x: x["id"])
    return by.select("cluster_id", "count", "last_ts", ids.alias("members"), F.slice(ids, -F.least(F.size("_m"), F.lit(5)), 5).alias("preview"))


def remapped_clusters(clusters: DataFrame, before: DataFrame, after: DataFrame, merged: DataFrame) -> DataFrame:
    """cluster_id, episode_ids: clusters over the episodes after reflection.

    clusters: cluster_id, episode_ids; before and after: ep_id, ts, episode; merged: cluster_id, ep_id, ts, episode of the
    episodes that reflection wrote. An episode is known again by its text and time; of equal ones the last id counts. A
    merged cluster holds its new episode; in others members that are not there any more are left out.
    """
    new = after.groupBy("episode", "ts").agg(F.max("ep_id").alias("new_id"))
    one = merged.join(new, ["episode", "ts"], "left").select("cluster_id", F.array(F.coalesce("new_id", "ep_id")).alias("ids"))
    rest = clusters.join(merged.select("cluster_id"), "cluster_id", "left_anti")
    held = rest.select("cluster_id", F.posexplode("episode_ids").alias("i", "ep_id")).join(before, "ep_id").join(new, ["episode", "ts"])
    by = held.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("i", "new_id"))).alias("_m")).select("cluster_id", F.transform("_m", lambda x: x["new_id"]).alias("_ids"))
    kept = rest.join(by, "cluster_id", "left").select("cluster_id", F.coalesce("_ids", F.array().cast("array<bigint>")).alias("ids"))
    return plain_union(one, kept).withColumnRenamed("ids", "episode_ids")


def category_retrieval(hits: DataFrame, scores: DataFrame, rerank: int, top_m: int = 50, weight: float = 0.1, top_n: int = 10) -> DataFrame:
    """query_id, rank, id, score: shares of categories from the recall, then scores of a reranker, then the boost, ``top_n`` of each query.

    hits: query_id, ord, id, score, category; scores: query_id, id, score for the first ``rerank`` hits.
    """
    mass = retrieve.category_mass(hits, top_m)
    pool = hits.filter(F.col("ord") <= rerank).drop("score").join(scores.select("query_id", "id", "score"), ["query_id", "id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    pool = pool.withColumn("ord", F.row_number().over(order))
    return retrieve.category_boost(pool, mass, weight).filter(F.col("rank") <= top_n)


def search_results(ranked: DataFrame, questions: DataFrame, digits: int = 4, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(question_id, conv_id, members, trace: the first ``top`` ids and their scores; question_id, rule of questions without a result).

    ranked: question_id, rank, id, score; questions: question_id, conv_id.
    """
    held = ranked.filter(F.col("rank") <= top).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", F.bround("score", digits).alias("score")))).alias("_r"))
    joined = questions.select("question_id", "conv_id").join(held, "question_id", "left")
    found = joined.filter("_r is not null").select("question_id", "conv_id", F.transform("_r", lambda x: x["id"]).alias("members"), F.transform("_r", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("trace"))
    return found, joined.filter("_r is null").select("question_id", F.lit("retrieval: no result").alias("rule"))


def scored_answers(answers: DataFrame, dropped: list[str], limit: int | None = None) -> DataFrame:
    """Answers without the categories left out, in the order of ``place``; the first ``limit`` of these in a smoke run."""
    kept = answers.filter(~F.col("category").cast("string").isin(dropped))
    return kept if limit is None else kept.withColumn("_n", F.row_number().over(Window.orderBy("place"))).filter(F.col("_n") <= limit).drop("_n")


def response_scores(replies: DataFrame) -> DataFrame:
    """request_id, i, score from a reranker's JSON, of either shape: results with index and relevance_score, or a list of scores.

    As many as were asked for (``expected``): missing ones are 0, further ones are left out.
    """
    results = F.from_json(F.get_json_object("reply", "$.results"), "array<struct<index:int,relevance_score:double>>")
    ordered = F.transform(F.array_sort(F.transform(results, lambda x, i: F.struct(F.coalesce(x["index"], F.lit(0)).alias("k"), i.alias("i"), F.coalesce(x["relevance_score"], F.lit(0.0)).alias("s")))), lambda x: x["s"])
    plain = F.from_json(F.get_json_object("reply", "$.scores"), "array<double>")
    scores = F.coalesce(ordered, plain, F.array().cast("array<double>"))
    padded = F.slice(F.concat(scores, F.array_repeat(F.lit(0.0), F.col("expected"))), F.lit(1), F.col("expected"))
    return replies.select("request_id", F.posexplode(padded).alias("i", "score"))


def report(accuracy: DataFrame, by_category: DataFrame, stages: DataFrame) -> DataFrame:
    """section, place, line: a run's report. accuracy: one row of n_questions, mean_accuracy, n_correct; by_category: category and the same; stages: stage, rows."""
    share = lambda a, c, n: F.concat(F.format_number(F.col(a) * 100, 2), F.lit("% ("), F.col(c).cast("string"), F.lit("/"), F.col(n).cast("string"), F.lit(")"))
    zero = F.lit(0).cast("bigint")
    head = accuracy.select(F.lit("overall").alias("section"), zero.alias("place"), share("mean_accuracy", "n_correct", "n_questions").alias("line"))
    each = by_category.select(F.lit("category").alias("section"), F.col("category").cast("bigint").alias("place"), F.concat(F.lit("category "), F.col("category").cast("string"), F.lit(": "), share("mean_accuracy", "n_correct", "n_questions")).alias("line"))
    ran = stages.select(F.lit("stage").alias("section"), F.row_number().over(Window.orderBy("stage")).cast("bigint").alias("place"), F.concat("stage", F.lit(": "), F.col("rows").cast("string"), F.lit(" rows")).alias("line"))
    return plain_union(head, each, ran)
