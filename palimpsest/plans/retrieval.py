"""Registered queries: vectors, fusion, retrieval, BM25.

The query set of the vector searches is every row whose vec_id is divisible by 50, against all other rows; labels stand for
parents, clusters and categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import bm25, fusion, retrieve, vectors
from palimpsest.sources.tables import table

DEPTH = 50

PAIRS_SQL = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.e AS qe, c.e AS ce FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS ord FROM (SELECT query_id, id, round(list_cosine_similarity(qe, ce), 6) AS score FROM pairs)) WHERE ord <= 50),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS ord FROM (SELECT query_id, id, round(20 / (1 + list_sum(list_transform(range(1, len(qe) + 1), lambda i: abs(qe[i] - ce[i])))), 6) AS score FROM pairs)) WHERE ord <= 50),
third AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS ord FROM (SELECT query_id, id, round(list_inner_product(qe, ce), 6) AS score FROM pairs)) WHERE ord <= 50)"""

_RRF = """, terms AS ({routes}),
fused AS (SELECT query_id, id, round(sum(round(1e12 / ({k} + ord))::BIGINT) / 1e12, 9) AS score, min(route * 1000 + ord) AS first FROM terms GROUP BY 1, 2),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM fused)"""


def _route(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT query_id, id, ord, score, {i} AS route FROM {n}" for i, n in enumerate(names))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def route(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir).drop("label")
    return vectors.top_k(corpus.filter("id % 50 = 0"), corpus, DEPTH, metric)


def _both(spark, sf_dir):
    return route(spark, sf_dir, "cosine"), route(spark, sf_dir, "l1")


def _members(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("cluster_ord"), F.concat(F.lit("cluster_"), F.col("label").cast("string")).alias("cluster_id"), F.col("vec_id").alias("id"))


def _labelled(hits, spark, sf_dir):
    return hits.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category")), "id")


def cosine_topk(spark, sf_dir):
    return route(spark, sf_dir, "cosine")


def maxsim_by_label(spark, sf_dir):
    children = _labelled(route(spark, sf_dir, "cosine"), spark, sf_dir).withColumnRenamed("category", "parent_id")
    parents = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("id"))
    return retrieve.maxsim(children, parents, top_n=20, min_score=0.0)


def score_propagation(spark, sf_dir):
    children = _labelled(route(spark, sf_dir, "cosine"), spark, sf_dir).withColumnRenamed("category", "parent_id")
    parents = children.groupBy("query_id", F.col("parent_id").alias("id")).agg(F.max("score").alias("score")).filter(F.col("id") != "0")
    return fusion.propagate(children, parents, alpha=0.6)


def rrf_two_routes(spark, sf_dir):
    return fusion.rrf(list(_both(spark, sf_dir)))


def rrf_three_routes(spark, sf_dir):
    return fusion.rrf([*_both(spark, sf_dir), route(spark, sf_dir, "dot")], k=40)


def lr_fusion(spark, sf_dir):
    return fusion.lr(*_both(spark, sf_dir))


def lr_calibrate(spark, sf_dir):
    return route(spark, sf_dir, "cosine").select("query_id", "ord", "id", F.round(fusion.calibrate(F.col("score")), 6).alias("score"))


def vector_anchored(spark, sf_dir):
    return fusion.vector_anchored(*_both(spark, sf_dir))


def weighted_score(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.round(fusion.weighted_score({"quality": F.col("quality"), "toxic": F.col("toxic") == 1}, {"quality": 1.5, "toxic": -2.0}, 0.25), 6).alias("score"))


def category_mass(spark, sf_dir):
    return retrieve.category_mass(_labelled(route(spark, sf_dir, "cosine"), spark, sf_dir))


def category_boost(spark, sf_dir):
    hits = _labelled(route(spark, sf_dir, "cosine"), spark, sf_dir)
    return retrieve.category_boost(hits, retrieve.category_mass(hits))


def profile_rank(spark, sf_dir):
    return retrieve.profile_rank(route(spark, sf_dir, "cosine"), threshold=0.05)


def hybrid_topn(spark, sf_dir):
    return retrieve.hybrid(*_both(spark, sf_dir), top_n=10)


def hybrid_min_score(spark, sf_dir):
    return retrieve.hybrid(*_both(spark, sf_dir), method="lr", top_n=20, min_score=0.02)


def cluster_first_hit(spark, sf_dir):
    return retrieve.first_hit_clusters(route(spark, sf_dir, "cosine"), _members(spark, sf_dir), top=3)


def _expansion(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"))
    return retrieve.expand(cluster_first_hit(spark, sf_dir), _members(spark, sf_dir), corpus)


def cluster_expand(spark, sf_dir):
    return _expansion(spark, sf_dir).drop("pos")


def cluster_ranked_cut(spark, sf_dir):
    return retrieve.ranked_cut(route(spark, sf_dir, "cosine"), _expansion(spark, sf_dir), route(spark, sf_dir, "l1"), cap=60)


def hybrid_cluster_retrieval(spark, sf_dir):
    """Two routes fused by rank, their first clusters, and the members of these cut by the second route."""
    fused = fusion.rrf(list(_both(spark, sf_dir))).withColumnRenamed("rank", "ord")
    members = _members(spark, sf_dir)
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"))
    expansion = retrieve.expand(retrieve.first_hit_clusters(fused, members, top=5), members, corpus)
    return retrieve.ranked_cut(fused, expansion, route(spark, sf_dir, "dot"), cap=40)


def round2_merge(spark, sf_dir):
    dense, sparse = _both(spark, sf_dir)
    return retrieve.second_round(dense.filter("ord <= 20"), sparse, cap=40)


def relevance_gate(spark, sf_dir):
    return retrieve.relevance_gate(lr_fusion(spark, sf_dir), True, min_score=0.05)[1]


def rerank_apply(spark, sf_dir):
    """The third route's scores stand in for a model's."""
    dense = route(spark, sf_dir, "cosine")
    return retrieve.apply_scores(dense, route(spark, sf_dir, "dot"), top_k=10)


def _bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25.score(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def bm25_scores(spark, sf_dir):
    return _bm25(spark, sf_dir)


def bm25_maxsim(spark, sf_dir):
    """Documents' scores raised to their source by the best."""
    hits = bm25.top(_bm25(spark, sf_dir), DEPTH)
    children = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id")), "id")
    return retrieve.maxsim(children, None, top_n=10)


_BM25 = """tok AS (SELECT doc_id AS id, source, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda t: length(t) >= 2) AS t FROM documents),
held AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok), post AS (SELECT id, dl, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT count(*) AS n_docs, sum(len(t)) AS total FROM tok WHERE len(t) > 0), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda t: length(t) >= 2)) AS term FROM benchmark) GROUP BY ALL),
shares AS (SELECT query_id, id, qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl * n_docs / total)) AS s FROM post JOIN asked USING (term) JOIN df USING (term), sizes),
scored AS (SELECT query_id, id, round(sum(round(s * 1e9)::BIGINT) / 1e9, 6) AS score FROM shares GROUP BY ALL)"""

_MASS = """hits AS (SELECT d.*, label::VARCHAR AS category FROM dense d JOIN embeddings ON id = vec_id),
m0 AS (SELECT query_id, category, sum(round(score * 1e6)::BIGINT) AS mass FROM hits WHERE ord <= 50 GROUP BY ALL),
m1 AS (SELECT *, mass / sum(mass) OVER (PARTITION BY query_id) AS p0, sum(mass) OVER (PARTITION BY query_id) AS total FROM m0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p0 DESC, category) AS n FROM m1 WHERE total > 0),
mass AS (SELECT a.query_id, category, round(a.p0, 6) AS p, round(CASE WHEN s IS NULL THEN 1.0 ELSE f - s END, 6) AS confidence FROM m2 a JOIN (SELECT query_id, max(CASE WHEN n = 1 THEN p0 END) AS f, max(CASE WHEN n = 2 THEN p0 END) AS s FROM m2 GROUP BY 1) b USING (query_id))"""

_CLUSTERS = """met AS (SELECT query_id, 'cluster_' || label::VARCHAR AS cluster_id, min(ord) AS o FROM {hits} JOIN embeddings ON id = vec_id GROUP BY ALL),
chosen AS (SELECT query_id, place, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o)::INT AS place FROM met) WHERE place <= {top}),
expansion AS (SELECT query_id, vec_id AS id, vec_id AS pos FROM chosen JOIN embeddings ON cluster_id = 'cluster_' || label::VARCHAR)"""

_CUT = """seeds AS (SELECT h.query_id, h.id, min(h.ord) AS key, 0 AS tier FROM {hits} h SEMI JOIN expansion e ON h.query_id = e.query_id AND h.id = e.id GROUP BY ALL),
rest AS (SELECT e.*, n, mo FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM expansion) e LEFT JOIN (SELECT query_id, id, min(ord) AS mo FROM {ranker} GROUP BY ALL) r ON r.query_id = e.query_id AND r.id = e.id WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = e.query_id AND s.id = e.id)),
joined AS (SELECT query_id, id, key, tier FROM seeds UNION ALL SELECT query_id, id, CASE WHEN n <= {cap} THEN pos ELSE mo END, 1 FROM rest WHERE n <= {cap} OR mo IS NOT NULL)
SELECT query_id, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, key)::INT AS rank FROM joined) WHERE rank <= {cap}"""

_LR = """, s AS (SELECT query_id, id, max_by(CASE WHEN route = 0 THEN score END, CASE WHEN route = 0 THEN ord END) AS a, max_by(CASE WHEN route = 1 THEN score END, CASE WHEN route = 1 THEN ord END) AS b, min(route * 1000 + ord) AS first FROM (SELECT query_id, id, ord, score, 0 AS route FROM dense UNION ALL SELECT query_id, id, ord, score, 1 FROM sparse) GROUP BY ALL),
fused AS (SELECT query_id, id, round(1 / (1 + exp(-(-4.858095765012703::DOUBLE + 6.27473151675093::DOUBLE * coalesce(a, 0.0::DOUBLE) + 0.09395183408310023::DOUBLE * coalesce(b, 0.0::DOUBLE)))), 6) AS score, first FROM s),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM fused)"""

_TWO = _RRF.format(routes=_route(["dense", "sparse"]), k=60)

QUERIES = {f.__name__: f for f in (cosine_topk, maxsim_by_label, score_propagation, rrf_two_routes, rrf_three_routes, lr_fusion, lr_calibrate, vector_anchored, weighted_score, category_mass, category_boost, profile_rank, hybrid_topn, hybrid_min_score, cluster_first_hit, cluster_expand, cluster_ranked_cut, hybrid_cluster_retrieval, round2_merge, relevance_gate, rerank_apply, bm25_scores, bm25_maxsim)}

ORACLE_SQL = {
    "cosine_topk": f"WITH {PAIRS_SQL} SELECT query_id, ord, id, score FROM dense",
    "maxsim_by_label": f"WITH {PAIRS_SQL}, by_ AS (SELECT query_id, label::VARCHAR AS id, max(score) AS score, min(ord) AS first FROM dense JOIN embeddings ON id = vec_id GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS n FROM by_) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INT AS rank, id, score FROM t WHERE n <= 20 AND score >= 0",
    "score_propagation": f"WITH {PAIRS_SQL}, c AS (SELECT query_id, ord, id, label::VARCHAR AS parent_id, score FROM dense JOIN embeddings ON id = vec_id), p AS (SELECT query_id, parent_id, max(score) AS ps FROM c WHERE parent_id <> '0' GROUP BY ALL) SELECT query_id, ord, id, parent_id, round(0.6::DOUBLE * score + (1 - 0.6::DOUBLE) * coalesce(ps, 0.0::DOUBLE), 6) AS score FROM c LEFT JOIN p USING (query_id, parent_id)",
    "rrf_two_routes": f"WITH {PAIRS_SQL}{_TWO} SELECT * FROM ranked",
    "rrf_three_routes": f"WITH {PAIRS_SQL}{_RRF.format(routes=_route(['dense', 'sparse', 'third']), k=40)} SELECT * FROM ranked",
    "lr_fusion": f"WITH {PAIRS_SQL}{_LR} SELECT * FROM ranked",
    "lr_calibrate": f"WITH {PAIRS_SQL} SELECT query_id, ord, id, round(1 / (1 + exp(-(6.27473151675093::DOUBLE * score - 4.858095765012703::DOUBLE))), 6) AS score FROM dense",
    "vector_anchored": f"WITH {PAIRS_SQL}, k AS (SELECT *, CASE WHEN score > 0 THEN score / (score + 5.0::DOUBLE) ELSE 0 END AS kk FROM sparse), b AS (SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.id, k.id) AS id, d.score AS v, kk, d.ord AS dd, k.ord AS so FROM dense d FULL JOIN k ON d.query_id = k.query_id AND d.id = k.id), f AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(v, min(v) OVER w, 0) + (1 - 0.7::DOUBLE) * coalesce(kk, min(kk) OVER w, 0), 6) AS score, CASE WHEN dd IS NOT NULL THEN dd ELSE 1000 + so END AS first FROM b WINDOW w AS (PARTITION BY query_id)) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM f",
    "weighted_score": "SELECT doc_id, round(1 / (1 + exp(-(0.25::DOUBLE + 1.5::DOUBLE * coalesce(quality, 0) - 2.0::DOUBLE * coalesce((toxic = 1)::INT, 0)))), 6) AS score FROM labels",
    "category_mass": f"WITH {PAIRS_SQL}, {_MASS} SELECT query_id, category, p, confidence FROM mass",
    "category_boost": f"WITH {PAIRS_SQL}, {_MASS}, b AS (SELECT h.*, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM hits h WINDOW w AS (PARTITION BY query_id)), s AS (SELECT b.query_id, ord, id, round(norm + 0.1::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(confidence, 0.0::DOUBLE))) * coalesce(p, 0.0::DOUBLE), 6) AS score FROM b LEFT JOIN mass m ON m.query_id = b.query_id AND m.category = b.category) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank, id, score FROM s",
    "profile_rank": f"WITH {PAIRS_SQL} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank FROM dense WHERE score >= 0.05) WHERE rank <= 10",
    "hybrid_topn": f"WITH {PAIRS_SQL}{_TWO} SELECT * FROM ranked WHERE rank <= 10",
    "hybrid_min_score": f"WITH {PAIRS_SQL}{_LR} SELECT * FROM ranked WHERE rank <= 20 AND score >= 0.02",
    "cluster_first_hit": f"WITH {PAIRS_SQL}, {_CLUSTERS.format(hits='dense', top=3)} SELECT * FROM chosen",
    "cluster_expand": f"WITH {PAIRS_SQL}, {_CLUSTERS.format(hits='dense', top=3)} SELECT query_id, id FROM expansion",
    "cluster_ranked_cut": f"WITH {PAIRS_SQL}, {_CLUSTERS.format(hits='dense', top=3)}, {_CUT.format(hits='dense', ranker='sparse', cap=60)}",
    "hybrid_cluster_retrieval": f"WITH {PAIRS_SQL}{_TWO}, f AS (SELECT query_id, rank AS ord, id FROM ranked), {_CLUSTERS.format(hits='f', top=5)}, {_CUT.format(hits='f', ranker='third', cap=40)}",
    "round2_merge": f"WITH {PAIRS_SQL}, one AS (SELECT * FROM dense WHERE ord <= 20), both_ AS (SELECT query_id, id, 1 AS round, ord FROM one UNION ALL SELECT query_id, id, 2, ord FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = s.query_id AND one.id = s.id)) SELECT query_id, rank, id, round FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round, ord)::INT AS rank FROM both_) WHERE rank <= 40",
    "relevance_gate": f"WITH {PAIRS_SQL}{_LR} SELECT query_id, count(*) FILTER (score < 0.05) AS n_dropped FROM ranked GROUP BY ALL",
    "rerank_apply": f"WITH {PAIRS_SQL} SELECT query_id, rank, id, score, fusion_score FROM (SELECT d.query_id, d.id, t.score, d.score AS fusion_score, row_number() OVER (PARTITION BY d.query_id ORDER BY t.score DESC, d.ord)::INT AS rank FROM dense d JOIN third t ON t.query_id = d.query_id AND t.id = d.id) WHERE rank <= 10",
    "bm25_scores": f"WITH {_BM25} SELECT * FROM scored",
    "bm25_maxsim": f"WITH {_BM25}, hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS ord FROM scored QUALIFY ord <= 50), b AS (SELECT query_id, source AS id, max(hits.score) AS score, min(ord) AS first FROM hits JOIN tok ON hits.id = tok.id WHERE source IS NOT NULL GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM b QUALIFY rank <= 10",
}
