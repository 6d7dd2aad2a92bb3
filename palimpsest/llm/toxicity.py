"""Toxicity by a factorization machine over hashed terms.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased, hashed to 2**32 places together with
prefixes of each longer run (inflected forms share them). The machine scores
  w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
over the terms present, so a pair such as an insult and a group's name weighs more, or less, than its parts.

Learning uses at most ``sample`` labelled rows (those of smallest hash of doc_id among the rows that ``train`` admits: a
documented bound). Terms are screened on them first: ``n_terms`` terms, a second bound by count, of ``least_df`` sample rows
at least, whose rates in the two classes differ most, by a z value of ``least_z`` at least; all others weigh nothing. So pairs
are learnt only between terms that differ alone: a term that matters in a pair only gets no factor. Both passes over
the sample aggregate before they shuffle, and only the screened terms and their places in sample rows reach the driver.
Scoring reads whole texts, in one pass without a shuffle.

Contract for odd input: null and empty texts get the score of a text without terms; null and repeated doc_ids are scored
row by row; rows without a label, or of a null label, are not learnt from; if no row or one class alone can be learnt
from, all scores are the share of label 1 among them (0 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import chunks, materialize, text_bytes
from palimpsest.llm.textops import LETTER, mix, run_hashes, runs

#: Bytes that the prefix terms of a longer run keep.
PREFIXES = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """True for the rows that learning never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, text of each), with repeats."""
    starts, ends, before = runs(raw, offsets, LETTER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    whole = run_hashes(raw, starts, ends) >> np.uint64(32)
    found, owner = [whole], [text]
    for size in PREFIXES:
        long = ends - starts > size
        found.append(mix(run_hashes(raw, starts[long], starts[long] + size) ^ np.uint64(size)) >> np.uint64(32))
        owner.append(text[long])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Machine:
    """A trained machine: places (sorted hashed terms), weights, factors, bias."""

    places: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def scores(self, found: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their terms."""
        at = np.searchsorted(self.places, found)
        at[at == len(self.places)] = 0
        hit = self.places[at] == found if len(self.places) else np.zeros(len(found), bool)
        pair = np.unique(text[hit].astype(np.int64) << 32 | at[hit])
        return _sigmoid(self.raw(pair >> 32, pair & 0xFFFFFFFF, n))

    def raw(self, rows: np.ndarray, terms_: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(rows, self.weights[terms_], n)
        out = self.bias + linear
        for f in range(self.factors.shape[1]):
            v = self.factors[terms_, f]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(rows: np.ndarray, place: np.ndarray, labels: np.ndarray, n_terms: int, rank: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on the log loss over ``steps`` minibatches at least, whole passes; rows are sorted."""
    rng = np.random.default_rng(17)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    # linear weights start at smoothed log odds, so that a term seen only beside others still counts when it stands alone
    n1 = labels.sum()
    c1 = np.bincount(place, labels[rows], n_terms)
    c0 = np.bincount(place, 1 - labels[rows], n_terms)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (len(labels) - n1 + 1))
    theta = np.concatenate([0.7 * np.clip(odds, -6, 6)[:, None], rng.normal(0, 0.05, (n_terms, rank))], axis=1)
    bias = np.array([np.log(share / (1 - share))])
    m, s, mb, sb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    begin = np.searchsorted(rows, np.arange(len(labels) + 1))
    while step < steps:
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 512):
            batch = order[at : at + 512]
            lengths = begin[batch + 1] - begin[batch]
            own = np.repeat(np.arange(len(batch)), lengths)
            take = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin[batch], lengths)
            j = place[take]
            v = theta[j, 1:]
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, own, v)
            squares = np.zeros((len(batch), rank))
            np.add.at(squares, own, v * v)
            z = bias[0] + np.bincount(own, theta[j, 0], len(batch)) + 0.5 * (sums**2 - squares).sum(1)
            error = (_sigmoid(z) - labels[batch]) / len(batch)
            grad = np.zeros_like(theta)
            np.add.at(grad, j, np.concatenate([error[own, None], error[own, None] * (sums[own] - v)], axis=1))
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            theta *= 1 - rate * decay  # apart from Adam's scaling, which would turn any decay into full steps
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            g = error.sum()
            mb, sb = 0.9 * mb + 0.1 * g, 0.999 * sb + 0.001 * g * g
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return theta[:, 0].copy(), theta[:, 1:].copy(), float(bias[0])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", admit: Column | None = None, sample: int = 20_000, n_terms: int = 2048, least_z: float = 5.0, least_df: int = 5, rank: int = 4, steps: int = 2000) -> Machine:
    """Learn from labelled documents; see the module's text for the bounds."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    if admit is not None:
        rows = rows.filter(admit)
    # at most ``sample`` narrow rows: a proven bound, so they are broadcast to the documents
    chosen = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    known = materialize(known, "labelled")

    def distinct_terms(batches):
        for batch in chunks(batches, "text"):
            found, text = terms(*text_bytes(batch.column(1)))
            pair = np.unique(text.astype(np.int64) << 32 | found)  # terms have 32 bits
            own = pa.array(pair >> 32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array(pair & 0xFFFFFFFF)], names=["doc_id", "y", "term"])

    found = known.select("doc_id", "text", "y").mapInArrow(distinct_terms, "doc_id bigint, y int, term bigint")
    size = known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["y"]: r["n"] for r in size}
    n1, n0 = sum(n for y, n in total.items() if y == 1), sum(n for y, n in total.items() if y != 1)
    empty = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n1 + n0 else -40.0)
    if not n1 or not n0:
        return empty
    per = found.groupBy("term").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("c1"), F.count(F.lit(1)).alias("c"))
    p1, p0, p = F.col("c1") / n1, (F.col("c") - F.col("c1")) / n0, F.col("c") / (n1 + n0)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    strong = per.filter(F.col("c") >= least_df).select("term", z.alias("z")).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(n_terms)
    places = np.sort(np.array([r["term"] for r in strong.collect()], np.int64))
    if not len(places):
        return empty
    def placed(batches):
        """The screened terms of each sample row, as places in ``places`` (2048 numbers at most)."""
        for batch in chunks(batches, "text"):
            found, text = terms(*text_bytes(batch.column(1)))
            at = np.minimum(np.searchsorted(places, found), len(places) - 1)
            hit = places[at] == found
            pair = np.unique(text[hit].astype(np.int64) << 32 | at[hit])
            ends = np.searchsorted(pair, np.arange(batch.num_rows + 1, dtype=np.int64) << 32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["doc_id", "y", "places"])

    data = known.select("doc_id", "text", "y").mapInArrow(placed, "doc_id bigint, y int, places array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    held = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in data["places"]]
    where = np.repeat(np.arange(len(held)), [len(h) for h in held])
    w, v, b = _fit(where, np.concatenate(held) if held else np.zeros(0, np.int64), (data["y"].to_numpy() == 1).astype(float), len(places), rank, steps, 0.01, 1e-3)
    return Machine(places, w, v, b)


def score(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    kept = documents.sparkSession.sparkContext.broadcast(machine)  # 2048 terms of rank 4: under 100 kB

    def run(batches):
        for batch in chunks(batches, "text"):
            found, text = terms(*text_bytes(batch.column(2)))
            value = kept.value.scores(found, text, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def clean(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` whose score is below the threshold, with all their columns."""
    kept = documents.sparkSession.sparkContext.broadcast(machine)
    text_at = documents.columns.index("text")

    def run(batches):
        for batch in chunks(batches, "text"):
            found, text = terms(*text_bytes(batch.column(text_at)))
            yield batch.filter(pa.array(kept.value.scores(found, text, batch.num_rows) < threshold))

    return documents.mapInArrow(run, documents.schema)
