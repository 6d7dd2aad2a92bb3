"""Rankers by memory type, and retrieval in two rounds, for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import fusion, retrieve
from palimpsest.session import plain_union


@dataclass(frozen=True)
class Ranker:
    """What a memory type supports; ``gate`` is the least score after a reranker, where there is one."""

    modes: tuple[str, ...]
    gate: float | None = None


#: Memory types and their rankers.
RANKERS = {
    "case": Ranker(("rrf", "lr", "vector_anchored")),
    "episode": Ranker(("rrf", "lr")),
    "skill": Ranker(("rrf", "lr"), gate=0.4),
    "profile": Ranker(()),
}


def rank(memory_type: str, mode: str, dense: DataFrame, sparse: DataFrame, top_k: int = 10, scores: DataFrame | None = None, k: int = fusion.RRF_K) -> DataFrame:
    """query_id, rank, id, score.

    A query with one route keeps that route's raw scores. ``scores`` (query_id, id, score) are a model's, applied to the
    first ``top_k``; only then a ranker's gate holds. Profiles have no mode: dense hits alone are ranked.
    """
    spec = RANKERS[memory_type]
    if memory_type == "profile":
        return retrieve.profile_rank(dense, top_k=top_k)
    if mode not in spec.modes:
        raise ValueError(f"mode: {memory_type} supports {spec.modes}")
    if mode == "vector_anchored":
        anchored = fusion.vector_anchored(dense, sparse)
        sides = dense.select("query_id").distinct().join(sparse.select("query_id").distinct(), "query_id", "left_semi")
        alone = dense.join(sides, "query_id", "left_anti").select("query_id", F.col("ord").alias("rank"), "id", "score")
        alone_s = sparse.join(sides, "query_id", "left_anti").select("query_id", F.col("ord").alias("rank"), "id", "score")
        fused = plain_union(anchored.join(sides, "query_id", "left_semi"), alone, alone_s).filter(F.col("rank") <= top_k)
    else:
        fused = retrieve.hybrid(dense, sparse, mode, k, top_k)
    if scores is None:
        return fused
    scored = retrieve.apply_scores(fused.withColumnRenamed("rank", "ord"), scores, top_k)
    if spec.gate is not None:
        scored = retrieve.relevance_gate(scored, True, spec.gate)[0]
    return scored


def two_rounds(first: DataFrame, verdicts: DataFrame, second: list[DataFrame], scores: DataFrame, cap: int = 40, top_n: int = 10, k: int = 40) -> DataFrame:
    """query_id, rank, id, rounds: what an agent returns for each query.

    first: the first round, reranked (query_id, ord, id). verdicts: query_id, sufficient. second: one route for each further
    query that the model asked; several are fused by rank, one is taken as it is. Insufficient queries merge both rounds
    within ``cap`` and are reranked by ``scores`` (query_id, id, score); ids that these lack come last, in merged order.
    """
    unsure = verdicts.filter(~F.col("sufficient")).select("query_id")
    sure = first.join(unsure, "query_id", "left_anti").filter(F.col("ord") <= top_n).select("query_id", F.col("ord").alias("rank"), "id", F.lit(1).alias("rounds"))
    if not second:
        return plain_union(sure, first.join(unsure, "query_id", "left_semi").filter(F.col("ord") <= top_n).select("query_id", F.col("ord").alias("rank"), "id", F.lit(2).alias("rounds")))
    more = fusion.rrf(second, k).withColumnRenamed("rank", "ord") if len(second) > 1 else second[0]
    merged = retrieve.second_round(first.join(unsure, "query_id", "left_semi"), more.join(unsure, "query_id", "left_semi").select("query_id", "ord", "id"), cap)
    scored = merged.join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    again = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top_n).select("query_id", F.col("n").alias("rank"), "id", F.lit(2).alias("rounds"))
    return plain_union(sure, again)
