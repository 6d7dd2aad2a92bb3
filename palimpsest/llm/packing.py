"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``size`` tokens; a full piece is a sequence by itself. The rest is dealt to parts at
random, each part is packed by best-fit decreasing, and dual-feasible functions give a lower bound for its bins. Where
bins equal the bound, no packing of that part is better: the part is certified. Until the bins of all parts meet the
bound of all pieces together, two kinds of exchange follow, each as often as it gains something:
 1. Parts with a gap give up all their pieces, which are dealt anew among them (documents so move between parts) and packed
    again, while certified parts stay whole.
 2. Once that gains nothing, or fewer than two parts have a gap, what is missed lies between the parts, as each rounds up
    its own bins: all parts, certified or not, give up the pieces of their open bins, which are dealt anew to fewer parts.
A new packing counts only if it needs fewer bins. Each exchange is dealt to a quarter of its parts, but to no wider ones than
``WIDEST`` and ``WIDEST_OPEN`` say, so a task never grows with the input; what an exchange without gain misses is left.

Dual-feasible functions: identity; rounding u_k (Fekete and Schepers) for k to 100; the threshold function of Martello and
Toth for every threshold.

Contract for odd input: a null text counts as empty; an empty text still has the end id; null and repeated doc_ids are
kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.fragments import encoder
from palimpsest.llm.runtime import ENCODER_BYTES, chunks, materialize, text_bytes
from palimpsest.session import plain_union

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces to a part, on average.
PART_PIECES = 40_000
#: The most pieces to a part in an exchange of documents and of open bins, on average, in PART_PIECES.
WIDEST, WIDEST_OPEN = 4, 64


def pieces(df: DataFrame, path: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each text."""

    def run(batches):
        source = encoder(path, "word")
        for batch in chunks(batches, "text", ENCODER_BYTES):
            ids, before = source.encode(*text_bytes(batch.column(1)))
            wide = ids.astype("<u4")
            end = np.array([end_id], "<u4")
            rows, number, start, length, crc, held = [], [], [], [], [], []
            edges = before.tolist()
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = np.concatenate([wide[a:b], end])
                for k, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size]
                    rows.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part.tobytes())
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(held, pa.binary())] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def lower_bound(counts: np.ndarray, size: int) -> int:
    """The best bound of the dual-feasible functions; counts[x] pieces have length x (1 <= x <= size)."""
    x = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((x * counts).sum()) // size)
    for k in range(1, 101):  # u_k, scaled by size * k
        scaled = np.where(x * (k + 1) % size == 0, x * k, ((k + 1) * x // size) * size)
        best = max(best, -(-int((scaled * counts).sum()) // (size * k)))
    number, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(x * counts)])
    e = np.arange(1, size // 2 + 1)
    large = number[-1] - number[size - e + 1]
    middle = weight[size - e + 1] - weight[e]
    return max(best, int((-(-(large * size + middle) // size)).max(initial=0)))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by best-fit decreasing. Open bins are stacks by room; a bit set finds the tightest."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b, opened = size, opened, opened + 1
        bins[i], offsets[i] = b, size - room
        left = room - need
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offsets


def _pack(size: int):
    def run(key, frame):
        order = np.lexsort((frame["start"].to_numpy(), frame["doc_id"].fillna(-1).to_numpy()))
        frame = frame.iloc[order].reset_index(drop=True)
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, size)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        return frame.assign(bin=bins, offset=offsets, open=filled[bins] < size, gap=np.int64(len(filled) - bound))

    return run


def pack(items: DataFrame, size: int, rounds: int | None = None) -> DataFrame:
    """``items`` (length of 1 to size, any other columns but those named here) with sequence_id and offset.

    ``rounds`` limits the exchanges; without it they go on until the bound is met or they gain nothing.
    """
    columns = items.columns
    keep = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    full = items.filter(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = items.filter(F.col("length") < size)
    # the histogram of all lengths has ``size`` rows at most
    counts = np.zeros(size + 1, np.int64)
    for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    bound = lower_bound(counts, size)

    def packed(now: DataFrame, k: int, parts: int) -> tuple[DataFrame, list]:
        """The pieces packed in ``parts`` parts, written; and bins, open bins, gap, pieces and pieces in open bins of each part."""
        part = F.pmod(F.xxhash64(F.lit(k), "doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
        out = now.select(*columns).withColumn("part", part).groupBy("part").applyInPandas(_pack(size), f"{keep}, part int, bin bigint, offset bigint, open boolean, gap bigint")
        out = materialize(out, "packed")
        figures = [F.max("bin") + 1, F.count_if(F.col("open") & (F.col("offset") == 0)), F.first("gap"), F.count(F.lit(1)), F.count_if("open")]
        return out, out.groupBy("part").agg(*[f.alias(n) for f, n in zip(figures, ("bins", "open_bins", "gap", "pieces", "loose"), strict=True)]).collect()

    def gained(former: list, state: list, figure: str) -> int:
        return sum(r[figure] for r in former) - sum(r["bins"] for r in state)

    k = 0
    now, state = packed(rest, k, max(1, -(-int(counts.sum()) // PART_PIECES)))
    total = sum(r["bins"] for r in state)
    held = [(k, now, state)]  # (exchange, frame, its parts) of all pieces as they lie
    while total > bound and (rounds is None or k < rounds):  # parts with a gap exchange documents
        last, now, state = held[-1]
        gaps = [r for r in state if r["gap"]]
        if len(gaps) < 2:
            break
        k += 1
        again, changed = packed(now.filter("gap > 0"), k, _joined(gaps, "pieces", WIDEST))
        gain = gained(gaps, changed, "bins")
        if gain <= 0:
            break
        held[-1:] = [(last, now.filter("gap = 0"), [r for r in state if not r["gap"]]), (k, again, changed)]
        total -= gain
    shut: list[DataFrame] = []
    while total > bound and (rounds is None or k < rounds):  # all parts exchange the pieces of open bins
        givers = [r for _, _, state in held for r in state if r["open_bins"]]
        if len(givers) < 2:
            break
        k += 1
        again, changed = packed(plain_union(*[now.filter("open").select(*columns) for _, now, _ in held]), k, _joined(givers, "loose", WIDEST_OPEN))
        gain = gained(givers, changed, "open_bins")
        if gain <= 0:
            break
        shut += [_numbered(now.filter(~F.col("open")), columns, j) for j, now, _ in held]
        held = [(k, again, changed)]
        total -= gain
    return plain_union(full, *shut, *[_numbered(now, columns, j) for j, now, _ in held])


def _joined(parts: list, figure: str, widest: int) -> int:
    """How many parts an exchange between ``parts`` is dealt to."""
    pieces_ = sum(r[figure] for r in parts)
    return max(1, -(-pieces_ // (widest * PART_PIECES)), min(len(parts) // 4, -(-pieces_ // PART_PIECES)))


def _numbered(packed: DataFrame, columns: list[str], k: int) -> DataFrame:
    """A sequence_id from round, part and bin."""
    number = F.lit(k).cast("bigint") * (1 << 48) + F.col("part").cast("bigint") * (1 << 28) + F.col("bin")
    return packed.select(*columns, number.alias("sequence_id"), "offset")


def packed_documents(df: DataFrame, path: str, end_id: int = 1, size: int = 4096, rounds: int | None = None) -> DataFrame:
    """Tokenize, cut and pack all texts: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(df, path, end_id, size), "pieces"), size, rounds)


def sequences(df: DataFrame, path: str, end_id: int = 1, size: int = 4096, rounds: int | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit). A sequence is bounded."""
    parts = pack(materialize(pieces(df, path, end_id, size, with_ids=True), "pieces"), size, rounds)
    by = parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return by.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
