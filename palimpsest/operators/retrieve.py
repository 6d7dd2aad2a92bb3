"""Retrieval over routes: parents by best child, hybrid fusion, clusters, categories, profiles, and second rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import fusion
from palimpsest.session import plain_union


def _place(*order) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def maxsim(children: DataFrame, parents: DataFrame | None = None, top_n: int = 20, min_score: float | None = None) -> DataFrame:
    """query_id, rank, id, score: parents by their best child.

    children: query_id, ord, id, parent_id, score. The best ``top_n`` parents are taken first, then those absent from
    ``parents`` (id) vanish, then ``min_score`` applies; nothing is filled up.
    """
    by = children.filter(F.col("parent_id").isNotNull()).groupBy("query_id", F.col("parent_id").alias("id")).agg(F.max("score").alias("score"), F.min("ord").alias("first"))
    top = by.withColumn("_n", _place(F.desc("score"), "first")).filter(F.col("_n") <= top_n)
    if parents is not None:
        top = top.join(parents.select("id").distinct(), "id", "left_semi")
    if min_score is not None:
        top = top.filter(F.col("score") >= min_score)
    return top.withColumn("rank", _place("_n")).select("query_id", "rank", "id", "score")


def hybrid(dense: DataFrame, sparse: DataFrame, method: str = "rrf", k: int = fusion.RRF_K, top_n: int = 10, min_score: float | None = None) -> DataFrame:
    """Fuse two routes; a query with one empty route keeps the other's raw scores. ``top_n`` comes before ``min_score``."""
    fused = fusion.rrf([dense, sparse], k) if method == "rrf" else fusion.lr(dense, sparse)
    have = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    sides = have(dense, "_d").join(have(sparse, "_s"), "query_id", "full_outer")
    both = sides.filter(F.col("_d") & F.col("_s")).select("query_id")
    alone_d = dense.join(sides.filter(F.col("_s").isNull()), "query_id", "left_semi")
    alone_s = sparse.join(sides.filter(F.col("_d").isNull()), "query_id", "left_semi")
    raw = plain_union(alone_d, alone_s).select("query_id", F.col("ord").alias("rank"), "id", "score")
    out = plain_union(fused.join(both, "query_id", "left_semi"), raw).filter(F.col("rank") <= top_n)
    return out.filter(F.col("score") >= min_score) if min_score is not None else out


def first_hit_clusters(hits: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """query_id, place, cluster_id: the first ``top`` distinct clusters in the order of hits (one at least).

    members: cluster_ord, cluster_id, id. An id in several clusters leads to the last of them; a cluster without id is invisible.
    """
    own = members.filter(F.col("cluster_id").isNotNull()).groupBy("id").agg(F.max_by("cluster_id", "cluster_ord").alias("cluster_id"))
    met = hits.join(own, "id").groupBy("query_id", "cluster_id").agg(F.min("ord").alias("ord"))
    return met.withColumn("place", _place("ord")).filter(F.col("place") <= max(top, 1)).select("query_id", "place", "cluster_id")


def expand(selected: DataFrame, members: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, pos, id: corpus rows (id, pos) in any selected cluster, once each, in corpus order."""
    held = selected.join(members, "cluster_id").select("query_id", "id").distinct()
    return held.join(corpus, "id").select("query_id", "pos", "id")


def ranked_cut(hits: DataFrame, expansion: DataFrame, member_rank: DataFrame, cap: int) -> DataFrame:
    """query_id, rank, id: hits inside the expansion first, then its other rows, ``cap`` in all.

    If all fits, the rest stays in corpus order; if not, it comes in the order of ``member_rank`` (query_id, ord, id) and
    what that does not rank is left out.
    """
    seeds = hits.join(expansion.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.min("ord").alias("key"))
    sized = expansion.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    rest = sized.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    ranked = member_rank.groupBy("query_id", "id").agg(F.min("ord").alias("mo"))
    rest = rest.join(ranked, ["query_id", "id"], "left")
    rest = rest.filter((F.col("n") <= cap) | F.col("mo").isNotNull()).select("query_id", "id", F.when(F.col("n") <= cap, F.col("pos")).otherwise(F.col("mo")).alias("key"), F.lit(1).alias("tier"))
    both = plain_union(seeds.select("query_id", "id", F.col("key").cast("bigint").alias("key"), F.lit(0).alias("tier")), rest.withColumn("key", F.col("key").cast("bigint")))
    return both.withColumn("rank", _place("tier", "key")).filter(F.col("rank") <= cap).select("query_id", "rank", "id")


def category_mass(hits: DataFrame, top_m: int = 50, digits: int = 6) -> DataFrame:
    """query_id, category, p, confidence: shares of score by category over the first ``top_m`` hits.

    hits: query_id, ord, id, score, category. Blank categories are skipped; queries of no positive mass give no row;
    confidence is the first share less the second, 1 for one category. Scores are added as integers of 10**-6.
    """
    m = hits.filter((F.col("ord") <= top_m) & (F.coalesce(F.col("category").cast("string"), F.lit("")) != ""))
    mass = m.groupBy("query_id", "category").agg(F.sum(F.round(F.col("score") * 1e6).cast("bigint")).alias("mass"))
    per = Window.partitionBy("query_id")
    mass = mass.withColumn("total", F.sum("mass").over(per)).filter(F.col("total") > 0).withColumn("p", F.col("mass") / F.col("total"))
    order = per.orderBy(F.desc("p"), "category")
    mass = mass.withColumn("second", F.nth_value("p", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("first", F.max("p").over(per))
    return mass.select("query_id", "category", F.round("p", digits).alias("p"), F.round(F.when(F.col("second").isNull(), 1.0).otherwise(F.col("first") - F.col("second")), digits).alias("confidence"))


def category_boost(hits: DataFrame, mass: DataFrame, weight: float = 0.1, digits: int = 6) -> DataFrame:
    """query_id, rank, id, score: min-max normalised scores (0.5 where flat) plus weight * confidence * share of the category."""
    per = Window.partitionBy("query_id")
    low, high = F.min("score").over(per), F.max("score").over(per)
    base = hits.withColumn("norm", F.when(high == low, 0.5).otherwise((F.col("score") - low) / (high - low)))
    boosted = base.join(mass, ["query_id", "category"], "left")
    value = F.col("norm") + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))) * F.coalesce("p", F.lit(0.0))
    out = boosted.select("query_id", "ord", "id", F.round(value, digits).alias("score"))
    return out.withColumn("rank", _place(F.desc("score"), "ord")).select("query_id", "rank", "id", "score")


def profile_rank(dense: DataFrame, threshold: float = 0.0, top_k: int = 10) -> DataFrame:
    """query_id, rank, id, score: dense hits at the threshold or above, first of each id."""
    first = dense.filter(F.col("score") >= threshold).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "ord"))).filter("_n = 1")
    return first.withColumn("rank", _place(F.desc("score"), "ord")).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def relevance_gate(ranked: DataFrame, reranked: bool, min_score: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(rows kept, query_id and n_dropped): the gate closes only after a reranker has scored."""
    keep = ranked.filter(F.col("score") >= min_score) if reranked else ranked
    dropped = ranked.groupBy("query_id").agg(F.count_if(F.lit(reranked) & (F.col("score") < min_score)).alias("n_dropped"))
    return keep, dropped


def second_round(first: DataFrame, second: DataFrame, cap: int) -> DataFrame:
    """query_id, rank, id, round: the first round's rows, then the second's new ones, ``cap`` in all."""
    new = second.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = plain_union(first.select("query_id", "id", F.lit(1).alias("round"), "ord"), new.select("query_id", "id", F.lit(2).alias("round"), "ord"))
    return both.withColumn("rank", _place("round", "ord")).filter(F.col("rank") <= cap).select("query_id", "rank", "id", "round")


def apply_scores(items: DataFrame, scores: DataFrame, top_k: int) -> DataFrame:
    """Take a model's scores (query_id, id, score) for items; unknown ids vanish, the former score stays as fusion_score."""
    joined = items.withColumnRenamed("score", "fusion_score").join(scores.select("query_id", "id", "score"), ["query_id", "id"])
    return joined.withColumn("rank", _place(F.desc("score"), "ord")).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "score", "fusion_score")
