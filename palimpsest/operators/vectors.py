"""Vector similarity: every query of a relation against every vector of another, in blocks, best ``k`` each.

Both sides are gathered into blocks inside their own tasks. Blocks meet on a grid: the corpus is dealt to as many parts as
there are shuffle partitions, the queries to parts of at most ``PART_BLOCKS`` blocks, and each part of one side meets each
of the other in a task of its own. A pair of blocks is one matrix product and yields ``k`` rows a query, so neither the pairs
of rows nor one side as a whole exist anywhere. The best of all blocks are taken by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l1")
#: Query blocks that a task may hold at once.
PART_BLOCKS = 16
_BLOCK = "dim int, block string, ids binary, vectors binary"


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:
    """Cosine of two array columns; ``guard`` is added to each norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / ((norm(a) + guard) * (norm(b) + guard))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(dim, block, ids, vectors) from (id, v)."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values, dtype=np.float64)
            sizes = np.diff(ends)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), rows):
                    part_rows = own[at : at + rows]
                    number += 1
                    data = flat[ends[part_rows][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([f"{part}-{number}"]), pa.array([ids[part_rows].astype("<i8").tobytes()]), pa.array([data.tobytes()])], names=["dim", "block", "ids", "vectors"])

    return df.mapInArrow(run, _BLOCK)


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ c.T
    if metric == "l1":
        return 20 / (1 + np.stack([np.abs(c - x).sum(1) for x in q]))
    return (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", digits: int = 6, rows: int = 4096) -> DataFrame:
    """query_id, ord, id, score: the best ``k`` rows of ``corpus`` for each row of ``queries``, both (id, v array<double>).

    A row is no candidate for a query of its own id. Scores are rounded to ``digits`` before ranking; ties go to the
    smaller id. With cosine, vectors of norm 0 take no part on either side. Vectors of other length do not meet.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("v") > 0))
        return df.filter(norm(F.col("v")) > 0) if metric == "cosine" else df

    deal = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qparts = max(1, -(-queries.count() // (rows * PART_BLOCKS)))
    asked = _blocks(usable(queries), rows).select("dim", deal("block", qparts).alias("qpart"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")).withColumn("part", every(parts))
    met = _blocks(usable(corpus), rows).select("dim", deal("block", parts).alias("part"), "ids", "vectors").withColumn("qpart", every(qparts))
    met = met.join(asked, ["dim", "part", "qpart"]).select("ids", "vectors", "qids", "qvectors")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data, qids, qdata = (batch.column(j)[i].as_py() for j in range(4))
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                c, q = (np.frombuffer(x, np.float64).reshape(n, -1) for x, n in ((data, len(ids)), (qdata, len(qids))))
                found = []
                for at in range(0, len(qids), 256):
                    score = np.round(_scores(q[at : at + 256], c, metric), digits)
                    score[qids[at : at + 256, None] == ids[None, :]] = -np.inf
                    for row, query in zip(score, qids[at : at + 256].tolist(), strict=True):
                        kth = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                        near = np.flatnonzero((row >= kth) & (row > -np.inf))
                        best = near[np.lexsort((ids[near], -row[near]))][:k]
                        found.append((np.full(len(best), query), ids[best], row[best]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("ord", place).filter(F.col("ord") <= k).select("query_id", "ord", "id", "score")
