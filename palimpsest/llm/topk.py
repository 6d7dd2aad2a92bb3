"""Exact top-k inner products by a bit-sliced index.

The index holds blocks of vectors. In a block each attribute (vector component) is quantised to ``BITS`` bits and kept as
bit slices: slice (d, b) is a bitmap with bit b of attribute d of every row. For a query the slices are added up with
their weights by bitmap arithmetic (full adders turn three bitmaps of one weight into one of that weight and one of the
next), which gives the sum of all rows as slices. Going down from the most significant slice finds the k-th largest sum.
Quantisation cost at most a known amount, so only rows whose sum is within that amount of the k-th can be among the top k: a
comparison of slices selects these boundary rows, and their exact integer products decide.

Slices are made once, when a block is written. Each query block meets each index block once; a pair yields k rows a query,
and the best k of a query over all blocks are taken by rank. No row is left out by the index, so the result is exact.
Blocks of vectors whose products could pass 2**62 are wide: their numbers are integers of any length instead of 64 bits.

Contract for odd input: vectors that are null or hold a null or non-finite component take no part, as queries or
candidates, nor do rows of a null vec_id; vectors of different length do not meet, so empty ones meet each other with score
0; rows of a query's own vec_id are no candidates for it; of repeated query ids the row of the smallest vector (component by
component) is the query; all rows of a repeated id are candidates of others; a score beyond the range of a long is given as the
nearest long, but ranked by its exact value; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.runtime import materialize, shuffle_partitions

BITS = 6
INDEX_ROWS, QUERY_ROWS = 8192, 512
_LONG = 2**63 - 1
_INDEX = "dim int, block string, wide boolean, ids binary, vectors binary, low string, shift string, slices binary"


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def narrow_limit(dim: int) -> int:
    """Components of at most this size have inner products under 2**62."""
    return 1 << (62 - max(1, dim).bit_length()) // 2


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): exact integers, as 64 bits where products fit, else of any length."""
    scaled = scale * x
    if not scaled.size or np.abs(scaled).max() < narrow_limit(x.shape[1]):
        return np.floor(scaled).astype(np.int64)
    out = np.empty(x.shape, object)
    for place, value in np.ndenumerate(x):
        out[place] = math.floor(Fraction(float(value)) * scale) if abs(value) > 2**52 else math.floor(scale * float(value))
    return out


def _blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length, all narrow or all wide, with their slices."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, {}

        def flush(kind):
            nonlocal number
            dim, wide = kind
            ids, xs = (np.concatenate(x) for x in zip(*held.pop(kind), strict=True))
            number += 1
            made = SlicedBlock.of(ids, whole(xs, scale))
            row = [dim, f"{part}-{number}", wide, ids.astype("<i8").tobytes(), xs.astype("<f8").tobytes(), json.dumps(made.low.tolist()), json.dumps(made.shift.tolist()), made.slices.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])

        types = [pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values, dtype=np.float64)
            sizes = np.diff(ends)
            for dim in np.unique(sizes).tolist():
                of_dim = np.flatnonzero(sizes == dim)
                xs = flat[(ends[of_dim][:, None] + np.arange(dim))].reshape(len(of_dim), dim)
                large = np.abs(xs).max(1, initial=0) * scale >= narrow_limit(dim)
                for wide in (False, True):
                    own, mine = ids[of_dim][large == wide], xs[large == wide]
                    while len(own):
                        kind = (dim, wide)
                        room = rows - sum(len(x) for x, _ in held.get(kind, []))
                        held.setdefault(kind, []).append((own[:room], mine[:room]))
                        own, mine = own[room:], mine[room:]
                        if sum(len(x) for x, _ in held[kind]) >= rows:
                            yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return vectors.mapInArrow(run, _INDEX)


class SlicedBlock:
    """The bit-sliced index of one block; ``vectors`` are integers of 64 bits, or objects of any length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, shift: np.ndarray, slices: np.ndarray):
        self.ids, self.vectors, self.low, self.shift, self.slices = ids, vectors, low, shift, slices
        self.words = -(-len(ids) // 64)
        self.inverse = ~slices
        live = np.zeros(self.words * 64, np.uint8)
        live[: len(ids)] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> SlicedBlock:
        n, dim = vectors.shape
        words = -(-n // 64)
        low = vectors.min(0) if dim else np.zeros(0, np.int64)
        width = (vectors.max(0) - low) if dim else low
        shift = np.array([max(int(w).bit_length() - BITS, 0) for w in width.tolist()], vectors.dtype)
        code = ((vectors - low) >> shift).astype(np.uint8)
        bits = np.zeros((dim, BITS, words * 64), np.uint8)
        for b in range(BITS):
            bits[:, b, :n] = ((code >> b) & 1).T
        return cls(ids, vectors, low, shift, np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(dim, BITS, words))

    def _sums(self, query: np.ndarray) -> np.ndarray:
        """Slices of sum |q_d| 2**shift_d c_d, least significant first; where q_d < 0 the complement of c_d stands for c_d.

        A negative weight times c is the weight's size times the complement, less a constant, so order is kept.
        """
        levels: dict[int, list[np.ndarray]] = {}
        weight = np.abs(query) << self.shift
        negative = (query < 0).astype(bool)
        for bit in range(max([int(w).bit_length() for w in weight.tolist()], default=0)):
            for inverse in (False, True):
                dims = np.flatnonzero((((weight >> bit) & 1) == 1).astype(bool) & (negative == inverse))
                if len(dims):
                    source = self.inverse if inverse else self.slices
                    for b in range(BITS):
                        levels.setdefault(bit + b, []).append(source[dims, b])
        out = []
        level = 0
        while levels:
            now = levels.pop(level, None)
            if now is None:
                out.append(np.zeros(self.words, np.uint64))
                level += 1
                continue
            rows = np.concatenate(now)
            carries = []
            while len(rows) > 1:
                k = len(rows) // 3
                if k:
                    a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                    half = a ^ b
                    carries.append((a & b) | (c & half))
                    rows = np.concatenate([half ^ c, rows[3 * k :]])
                else:
                    carries.append(rows[:1] & rows[1:2])
                    rows = rows[:1] ^ rows[1:2]
            out.append(rows[0])
            if carries:
                levels.setdefault(level + 1, []).extend(carries)
            level += 1
        return np.array(out) if out else np.zeros((1, self.words), np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the exact best k rows of the block, ties to the smaller id."""
        live = self.live.copy()
        a, b = np.searchsorted(self.sorted, [query_id, query_id + 1])
        for i in self.order[a:b].tolist():
            live[i // 64] &= ~np.uint64(1 << (i % 64))
        total = int(np.bitwise_count(live).sum())
        if total <= k:
            chosen = live
        else:
            sums = self._sums(query)
            sure, tied, threshold, have = np.zeros_like(live), live.copy(), 0, 0
            for level in range(len(sums) - 1, -1, -1):  # the k-th largest sum, from the top slice down
                on = tied & sums[level]
                n = have + int(np.bitwise_count(on).sum())
                if n >= k:
                    tied, threshold = on, threshold | 1 << level
                else:
                    sure, tied, have = sure | on, tied & ~sums[level], n
            # what quantisation may have cost either row
            least = threshold - int((np.abs(query) * ((1 << self.shift) - 1)).sum())
            chosen = live if least <= 0 else live & _at_least(sums, least)
        rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores = self.vectors[rows] @ query if len(query) else np.zeros(len(rows), np.int64)
        ids = self.ids[rows]
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else _best(ids, scores, k)
        return ids[best], scores[best]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _beyond(score: int) -> bytes | None:
    """Bytes that sort like scores beyond the range of a long; null for others."""
    if -_LONG < score < _LONG:
        return None
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    key = len(size).to_bytes(4, "big") + size
    return b"\1" + key if score > 0 else b"\0" + bytes(255 - x for x in key)


def _at_least(sums: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose sum is ``value`` or more."""
    if value >> len(sums):
        return np.zeros(sums.shape[1], np.uint64)
    above, equal = np.zeros(sums.shape[1], np.uint64), np.full(sums.shape[1], ~np.uint64(0))
    for level in range(len(sums) - 1, -1, -1):
        if value >> level & 1:
            equal = equal & sums[level]
        else:
            above = above | (equal & sums[level])
            equal = equal & ~sums[level]
    return above | equal


def search(df: DataFrame, queries: Column, k: int = 5, scale: int = 256, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every row that ``queries`` selects, against all rows."""
    spark = df.sparkSession
    vectors = usable(df)
    index = materialize(_blocks(vectors, index_rows, scale), "index")
    asked = vectors.filter(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = materialize(_blocks(asked, query_rows, scale).select("dim", F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")), "queries")
    # the pairs of block names are few short rows; the blocks themselves meet by name
    pairs = index.select("dim", "block").join(asked.select("dim", "qblock"), "dim").select("dim", "block", "qblock")
    parts = shuffle_partitions(spark)
    met = pairs.join(index, ["dim", "block"]).join(asked, ["dim", "qblock"])
    met = met.select("dim", "ids", "vectors", "low", "shift", "slices", "qids", "qvectors", "block", "qblock").repartition(parts, "block", "qblock")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, xs, low, shift, slices, qids, qxs = (batch.column(c)[i].as_py() for c in range(8))
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                vectors, asked = (whole(np.frombuffer(x, "<f8").reshape(len(n), dim), scale) for x, n in ((xs, ids), (qxs, qids)))
                kind = object if object in (vectors.dtype, asked.dtype) else np.int64
                low, shift = (np.array(json.loads(x), kind) for x in (low, shift))
                block = SlicedBlock(ids, vectors.astype(kind), low, shift, np.frombuffer(slices, np.uint64).reshape(dim, BITS, -(-len(ids) // 64)))
                rows = [(q, int(d), int(s)) for q, v in zip(qids.tolist(), asked.astype(kind), strict=True) for d, s in zip(*block.top(q, v, k), strict=True)]
                if rows:
                    query, vec_id, score = zip(*rows, strict=True)
                    arrays = [pa.array(query, pa.int64()), pa.array(vec_id, pa.int64()), pa.array([max(-_LONG - 1, min(_LONG, s)) for s in score], pa.int64()), pa.array([_beyond(s) for s in score], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score", "beyond"])

    best = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Products are summed as doubles here, which is exact while sums stay under 2**53.
SEARCH_SQL = """
WITH x AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), q AS (
  SELECT vec_id, list_transform(min(x), lambda c: floor(256 * c)) AS v FROM x WHERE vec_id % 50 = 0 GROUP BY vec_id
), c AS (
  SELECT vec_id, list_transform(x, lambda c: floor(256 * c)) AS v FROM x
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS s
  FROM q JOIN c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, CASE WHEN s >= 9223372036854775807 THEN 9223372036854775807 WHEN s <= -9223372036854775808 THEN -9223372036854775808 ELSE s::BIGINT END AS score
FROM ranked WHERE rank <= 5
"""
