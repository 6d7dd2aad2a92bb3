"""Fusing retrieval routes. A route is (query_id, ord, id, score); ``ord`` is the 1-based place in that route's list.

All results are relations over many queries at once. Where an order is part of the result it is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import plain_union

#: The trained coefficients of two-route logistic fusion.
LR_EMBEDDING, LR_KEYWORD, LR_INTERCEPT = 6.27473151675093, 0.09395183408310023, -4.858095765012703
RRF_K = 60


def _tagged(routes: list[DataFrame]) -> DataFrame:
    kept = [r.filter((F.col("id").cast("string") != "") & F.col("id").isNotNull()).select("query_id", F.lit(i).alias("route"), "ord", "id", "score") for i, r in enumerate(routes)]
    return plain_union(*kept)


def _ranked(df: DataFrame) -> DataFrame:
    """Add rank: by score, then by first place in the routes."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "route", "first"))
    return df.withColumn("rank", place).select("query_id", "rank", "id", "score")


def rrf(routes: list[DataFrame], k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion: a list that holds an id twice adds a term for each place.

    Terms are added as integers of 10**-12, so the sum does not depend on their order.
    """
    term = F.round(F.lit(1e12) / (k + F.col("ord"))).cast("bigint")
    by = _tagged(routes).groupBy("query_id", "id").agg(F.sum(term).alias("t"), F.min(F.struct("route", "ord")).alias("f"))
    return _ranked(by.select("query_id", "id", F.round(F.col("t") / 1e12, digits).alias("score"), F.col("f.route").alias("route"), F.col("f.ord").alias("first")))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weighted_fusion(routes: list[DataFrame], coefficients: list[float], intercept: float, digits: int = 6) -> DataFrame:
    """logistic(intercept + sum of coefficient times the last score of the id in each route); an absent route adds 0."""
    tagged = _tagged(routes)
    last = [F.max_by(F.when(F.col("route") == i, F.col("score")), F.when(F.col("route") == i, F.col("ord"))).alias(f"s{i}") for i in range(len(routes))]
    by = tagged.groupBy("query_id", "id").agg(*last, F.min(F.struct("route", "ord")).alias("f"))
    total = F.lit(float(intercept))
    for i, c in enumerate(coefficients):
        total = total + F.lit(float(c)) * F.coalesce(F.col(f"s{i}"), F.lit(0.0))
    return _ranked(by.select("query_id", "id", F.round(logistic(total), digits).alias("score"), F.col("f.route").alias("route"), F.col("f.ord").alias("first")))


def lr(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    return weighted_fusion([dense, sparse], [LR_EMBEDDING, LR_KEYWORD], LR_INTERCEPT)


def calibrate(score: Column) -> Column:
    """A dense score alone on the logistic scale."""
    return logistic(F.lit(LR_EMBEDDING) * score + F.lit(LR_INTERCEPT))


def vector_anchored(dense: DataFrame, sparse: DataFrame, saturation: float = 5.0, alpha: float = 0.7, digits: int = 6) -> DataFrame:
    """alpha * dense + (1 - alpha) * saturated sparse; a side that lacks the id counts as that side's smallest value."""
    kept = lambda df: df.filter((F.col("id").cast("string") != "") & F.col("id").isNotNull())
    d = kept(dense).groupBy("query_id", "id").agg(F.max_by("score", "ord").alias("v"), F.min("ord").alias("do"))
    s = kept(sparse).withColumn("k", F.when(F.col("score") > 0, F.col("score") / (F.col("score") + saturation)).otherwise(0.0))
    s = s.groupBy("query_id", "id").agg(F.max_by("k", "ord").alias("k"), F.min("ord").alias("so"))
    both = d.join(s, ["query_id", "id"], "full_outer")
    per = Window.partitionBy("query_id")
    v = F.coalesce("v", F.min("v").over(per), F.lit(0.0))
    k = F.coalesce("k", F.min("k").over(per), F.lit(0.0))
    out = both.select("query_id", "id", F.round(alpha * v + (1 - alpha) * k, digits).alias("score"), F.when(F.col("do").isNotNull(), 0).otherwise(1).alias("route"), F.coalesce("do", "so").alias("first"))
    return _ranked(out)


def propagate(children: DataFrame, parents: DataFrame, alpha: float = 1.0, digits: int = 6) -> DataFrame:
    """alpha * child + (1 - alpha) * parent, in the children's order; a missing parent counts 0.

    children: query_id, ord, id, parent_id, score; parents: query_id, id, score.
    """
    p = parents.select("query_id", F.col("id").alias("parent_id"), F.col("score").alias("_p"))
    mixed = alpha * F.col("score") + (1 - alpha) * F.coalesce("_p", F.lit(0.0))
    return children.join(p, ["query_id", "parent_id"], "left").select("query_id", "ord", "id", "parent_id", F.round(mixed, digits).alias("score"))


def weighted_score(features: dict[str, Column], coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    """logistic of weighted features; absent ones count 0, booleans 0 and 1."""
    total = F.lit(float(intercept))
    for name, c in coefficients.items():
        total = total + F.lit(float(c)) * F.coalesce(features[name].cast("double"), F.lit(0.0))
    return logistic(total)
