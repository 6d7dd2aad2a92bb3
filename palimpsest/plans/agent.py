"""Registered queries: ranker facades, two-round retrieval, and extraction finished from scripted replies.

Replies are made from the rows themselves by declared rules, so that both engines can make them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import extraction, facade
from palimpsest.plans.retrieval import PAIRS_SQL, _both, route
from palimpsest.sources.tables import ITEMS_SQL, items, table


def rank_skill_gated(spark, sf_dir):
    dense, sparse = _both(spark, sf_dir)
    return facade.rank("skill", "rrf", dense, sparse, top_k=20, scores=route(spark, sf_dir, "dot"))


def agentic_two_rounds(spark, sf_dir):
    """Queries whose first hit scores under 0.9 ask again, by two more routes."""
    dense, sparse = _both(spark, sf_dir)
    verdicts = dense.filter("ord = 1").select("query_id", (F.col("score") >= 0.9).alias("sufficient"))
    third = route(spark, sf_dir, "dot")
    return facade.two_rounds(dense.filter("ord <= 15"), verdicts, [sparse, third], third, cap=30, top_n=10)


def _good(df, kind):
    """Requests over ``df`` (key columns and ``reply``) read as that kind."""
    from palimpsest.operators import model

    asked = model.requests(df, kind, F.lit("Reply in JSON."), F.to_json(F.struct(*df.columns)))
    return extraction.read(asked.drop("reply"), asked.select("request_hash", "reply", F.lit(None).cast("string").alias("error")), kind)


def extracted_episodes(spark, sf_dir):
    """A cell is a conversation; every fourth reply has a blank title."""
    c = items(spark, sf_dir).groupBy(F.col("conv_id").alias("cell_id")).agg(F.max("ts").alias("ts"), F.min_by("content", "pos").alias("body"))
    title = F.when(F.col("cell_id") % 4 == 0, " ").otherwise(F.concat(F.lit("On "), F.col("cell_id").cast("string")))
    good, _ = _good(c.select("cell_id", "ts", F.to_json(F.struct(title.alias("title"), F.col("body").alias("content"))).alias("reply")), "episode")
    return extraction.episodes(good)[0].select("cell_id", "ts", "subject", F.md5("episode").alias("episode"), "summary")


def extracted_episode_errors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cell_id")).distinct()
    title = F.when(F.col("cell_id") % 4 == 0, " ").otherwise("t")
    good, _ = _good(c.select("cell_id", F.lit(0).alias("ts"), F.to_json(F.struct(title.alias("title"), F.lit("x").alias("content"))).alias("reply")), "episode")
    return extraction.episodes(good)[1]


def extracted_facts(spark, sf_dir):
    c = items(spark, sf_dir).filter("kind = 'text'").groupBy(F.col("conv_id").alias("ep_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: F.when(x["pos"] % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), x["content"]))).alias("facts"))
    good, _ = _good(c.select("ep_id", F.to_json(F.struct(F.struct(F.col("facts").alias("atomic_fact")).alias("atomic_facts"))).alias("reply")), "facts")
    return extraction.facts(good)


def reply_errors(spark, sf_dir):
    """Replies of five shapes, of which one is right."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    reply = F.element_at(F.array(*[F.lit(x) for x in (
        '{"is_sufficient": true, "reasoning": "", "key_information_found": [], "missing_information": []}', "no json", '{"is_sufficient": 1, "reasoning": "", "key_information_found": [], "missing_information": []}',
        '{"is_sufficient": true, "reasoning": "", "key_information_found": ["a", 2], "missing_information": []}', '{"is_sufficient": true, "reasoning": "", "key_information_found": [], "missing_information": [], "why": ""}')]), (F.col("item_id") % 5 + 1).cast("int"))
    _, bad = _good(b.select("item_id", reply.alias("reply")), "sufficient")
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def classified_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.concat(F.coalesce("lang", F.lit("")), F.lit(" ")).alias("category_id"))).alias("reply"))
    known = spark.createDataFrame([("en",), ("fr",), ("xx",)], "id string")
    good, _ = _good(d, "category")
    return extraction.categories(good, known)


def reflected_episodes(spark, sf_dir):
    """Vectors' labels are clusters; odd ones were merged."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ep_id"), F.col("label").cast("bigint").alias("cluster_id"), F.col("vec_id").alias("ts"), F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("episode"), F.array(F.col("vec_id")).alias("memcell_ids"))
    merged = e.filter("cluster_id % 2 = 1").select("cluster_id").distinct().withColumn("episode", F.lit("merged"))
    return extraction.reflected(e, merged).select("cluster_id", "ts", "episode", F.size("memcell_ids").cast("bigint").alias("n_cells"))


QUERIES = {f.__name__: f for f in (rank_skill_gated, agentic_two_rounds, extracted_episodes, extracted_episode_errors, extracted_facts, reply_errors, classified_documents, reflected_episodes)}

_FUSE = "SELECT query_id, id, round(sum(round(1e12 / ({k} + ord))::BIGINT) / 1e12, 9) AS score, min(r * 1000 + ord) AS first FROM ({routes}) GROUP BY 1, 2"

ORACLE_SQL = {
    "rank_skill_gated": f"WITH {PAIRS_SQL}, f AS ({_FUSE.format(k=60, routes='SELECT query_id, id, ord, 0 AS r FROM dense UNION ALL SELECT query_id, id, ord, 1 FROM sparse')}), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS n FROM f QUALIFY n <= 20), s AS (SELECT t.query_id, t.id, x.score, t.score AS fusion_score, row_number() OVER (PARTITION BY t.query_id ORDER BY x.score DESC, n)::INT AS rank FROM top t JOIN third x ON x.query_id = t.query_id AND x.id = t.id) SELECT query_id, rank, id, score, fusion_score FROM s WHERE score >= 0.4",
    "agentic_two_rounds": f"WITH {PAIRS_SQL}, verdict AS (SELECT query_id, score >= 0.9 AS ok FROM dense WHERE ord = 1), one AS (SELECT * FROM dense WHERE ord <= 15), f AS ({_FUSE.format(k=40, routes='SELECT query_id, id, ord, 0 AS r FROM sparse UNION ALL SELECT query_id, id, ord, 1 FROM third')}), more AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS ord FROM f), m AS (SELECT query_id, id, 1 AS r, ord FROM one UNION ALL SELECT query_id, id, 2, ord FROM more x WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = x.query_id AND one.id = x.id)), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, ord) AS n FROM m QUALIFY n <= 30), g AS (SELECT c.query_id, c.id, row_number() OVER (PARTITION BY c.query_id ORDER BY t.score DESC NULLS LAST, n)::INT AS rank FROM c JOIN verdict v ON v.query_id = c.query_id AND NOT ok LEFT JOIN third t ON t.query_id = c.query_id AND t.id = c.id) SELECT query_id, rank, id, 2 AS rounds FROM g WHERE rank <= 10 UNION ALL SELECT query_id, ord, id, 1 FROM dense JOIN verdict USING (query_id) WHERE ok AND ord <= 10",
    "extracted_episodes": f"WITH {ITEMS_SQL}, c AS (SELECT conv_id AS cell_id, max(ts) AS ts, trim(min_by(content, pos)) AS body FROM items GROUP BY ALL) SELECT cell_id, ts, 'On ' || cell_id AS subject, md5(body) AS episode, substr(body, 1, 200) AS summary FROM c WHERE cell_id % 4 <> 0",
    "extracted_episode_errors": "SELECT DISTINCT conv_id AS cell_id, 'title: blank' AS rule FROM conversations WHERE conv_id % 4 = 0",
    "extracted_facts": f"WITH {ITEMS_SQL} SELECT conv_id AS ep_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INT AS fact_no, trim(content) AS content FROM items WHERE kind = 'text' AND pos % 4 <> 1 AND trim(content) <> ''",
    "reply_errors": "SELECT ['reply: not JSON', 'is_sufficient: not of kind bool', 'key_information_found[1]: not of kind str', 'why: unknown field'][item_id % 5] AS rule, count(*) AS n FROM benchmark WHERE item_id % 5 > 0 GROUP BY ALL",
    "classified_documents": "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '' END AS category_id FROM documents",
    "reflected_episodes": "WITH e AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label::BIGINT AS cluster_id, max(vec_id) AS ts, 'merged' AS episode, count(*) AS n_cells FROM e WHERE n >= 2 AND label % 2 = 1 GROUP BY ALL UNION ALL SELECT label::BIGINT, vec_id, 'e' || vec_id, 1 FROM e WHERE n < 2 OR label % 2 = 0",
}
