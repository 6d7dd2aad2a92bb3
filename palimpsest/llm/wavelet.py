"""Token-id shards as wavelet matrices: one compressed file answers access, counting and occurrence lookup.

A shard maps its ids to a dense alphabet and stores one bit-plane per bit of the dense code, most significant first; each
plane is followed by a stable partition by its bit. Planes are cut into blocks, each compressed by itself, with the
number of ones before each block, so that a lookup opens a few blocks only.

File: magic, length of header, JSON header, then the sections that it names (doc ids, doc lengths, alphabet, and for each
plane block offsets, ones before each block, and blocks).

Contract for odd input: a null text counts as empty and holds the end id alone; rows of a null doc_id come first; rows of
equal doc_id are ordered by text; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.fragments import encoder
from palimpsest.llm.runtime import ENCODER_BYTES, chunks, materialize, read_file, scratch_dir, shuffle_partitions, text_bytes, write_file

MAGIC = b"PWAVELT1"
BLOCK_BYTES = 4096


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The bytes of one shard file."""
    n = len(ids)
    top = int(ids.max()) + 1 if n else 0
    alphabet = np.flatnonzero(np.bincount(ids, minlength=top)) if n else np.zeros(0, np.int64)
    levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    dense = np.zeros(top, np.uint16 if len(alphabet) <= 65536 else np.uint32)
    dense[alphabet] = np.arange(len(alphabet), dtype=dense.dtype)
    seq = dense[ids]
    pack = zstandard.ZstdCompressor(level=1).compress
    sections: dict[str, bytes] = {
        "ids": pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()),
        "null": pack(np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()),
        "lengths": pack(np.asarray(lengths, "<i8").tobytes()),
        "alphabet": pack(alphabet.astype("<u4").tobytes()),
    }
    zeros = []
    for level in range(levels):
        bit = ((seq >> (levels - 1 - level)) & 1).astype(bool)
        off = ~bit
        zeros.append(int(np.count_nonzero(off)))
        plane = np.packbits(bit)
        pieces = [pack(plane[i : i + BLOCK_BYTES].tobytes()) for i in range(0, len(plane), BLOCK_BYTES)]
        ones = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), BLOCK_BYTES)) if len(plane) else np.zeros(0, np.int64)
        sections[f"at{level}"] = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype("<u4").tobytes()
        sections[f"ones{level}"] = np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()
        sections[f"plane{level}"] = b"".join(pieces)
        if level + 1 < levels:
            seq = np.concatenate([seq[off], seq[bit]])
    places, at = {}, 0
    for name, data in sections.items():
        places[name] = [at, len(data)]
        at += len(data)
    header = json.dumps({"n": n, "docs": len(doc_ids), "levels": levels, "zeros": zeros, "sections": places}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections.values())


class WaveletShard:
    """Queries over one shard file without unpacking it: access, rank, select, count; ``decode`` unpacks all of it."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", data, len(MAGIC))[0]
        self.head = json.loads(data[len(MAGIC) + 4 : len(MAGIC) + 4 + size])
        self.data, self.base = memoryview(data), len(MAGIC) + 4 + size
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        unpack = zstandard.ZstdDecompressor().decompress
        mask = np.unpackbits(np.frombuffer(unpack(self._section("null")), np.uint8), count=self.head["docs"])
        self.doc_ids = [None if m else int(d) for d, m in zip(np.frombuffer(unpack(self._section("ids")), "<i8"), mask, strict=True)]
        self.lengths = np.frombuffer(unpack(self._section("lengths")), "<i8")
        self.alphabet = np.frombuffer(unpack(self._section("alphabet")), "<u4")
        self.at = [np.frombuffer(self._section(f"at{k}"), "<u4") for k in range(self.levels)]
        self.ones = [np.frombuffer(self._section(f"ones{k}"), "<u4") for k in range(self.levels)]
        self._block = functools.lru_cache(maxsize=256)(self._read_block)

    def _section(self, name: str) -> memoryview:
        at, size = self.head["sections"][name]
        return self.data[self.base + at : self.base + at + size]

    def _read_block(self, level: int, block: int) -> np.ndarray:
        at = self.at[level]
        piece = self._section(f"plane{level}")[int(at[block]) : int(at[block + 1])]
        return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(piece), np.uint8))

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // (8 * BLOCK_BYTES))[i % (8 * BLOCK_BYTES)])

    def _ones_before(self, level: int, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        return int(self.ones[level][block]) + (int(np.count_nonzero(self._block(level, block)[:rest])) if rest else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` in a plane."""
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before), dtype=np.int64) * 8 * BLOCK_BYTES, self.n) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = self._block(level, block)[: self.n - block * 8 * BLOCK_BYTES]
        return block * 8 * BLOCK_BYTES + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            ones = self._ones_before(level, i)
            bit = self._bit(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = 2 * code + bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        code = int(np.searchsorted(self.alphabet, token))
        return code if code < len(self.alphabet) and self.alphabet[code] == token else None

    def _interval(self, code: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.levels):
            x, y = self._ones_before(level, a), self._ones_before(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if code >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` occurs in places start..end."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._interval(code, start, self.n if end is None else end)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before place i."""
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        code = self._code(token)
        a, b = self._interval(code, 0, self.n) if code is not None else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.levels)):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        if not self.n:
            return np.zeros(0, np.uint32)
        unpack = zstandard.ZstdDecompressor().decompress
        planes = []
        for level in range(self.levels):
            at, data = self.at[level], self._section(f"plane{level}")
            raw = b"".join(unpack(data[int(a) : int(b)]) for a, b in zip(at, at[1:]))
            planes.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool))
        wide = np.uint16 if self.levels <= 16 else np.uint32
        lower = np.zeros(self.n, wide)
        for level in reversed(range(self.levels)):
            bit, zeros = planes.pop(), self.zeros[level]
            here = np.empty(self.n, wide)
            here[~bit] = lower[:zeros]
            here[bit] = lower[zeros:] | wide(1 << (self.levels - 1 - level))
            lower = here
        return self.alphabet[lower]


def write_shards(df: DataFrame, path: str, folder: str, end_id: int, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode and write all texts in ascending doc_id order; return one row per shard: part, seq, path, n_docs, n_tokens.

    Rows are dealt by ranges of doc_id; each task writes its range as shards of about ``shard_tokens`` ids (a longer
    document gets a shard of its own), so that memory does not grow with the range.
    """

    def run(batches):
        source = encoder(path, "byte")
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        size = seq = 0

        def flush():
            nonlocal held, docs, counts, size, seq
            ids, lengths = np.concatenate(held), np.concatenate(counts)
            where = write_file(folder, f"shard-{part:06d}-{seq:06d}", build(ids, docs, lengths))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": where, "n_docs": len(docs), "n_tokens": len(ids)}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            held, docs, counts, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in chunks(batches, "text", ENCODER_BYTES):
            ids, before = source.encode(*text_bytes(batch.column(1)))
            ids = np.insert(ids, before[1:], np.array(end_id, ids.dtype))
            lengths = np.diff(before) + 1
            if size and size + len(ids) > shard_tokens:
                yield flush()
            held.append(ids)
            docs += batch.column(0).to_pylist()
            counts.append(lengths)
            size += len(ids)
        if size:
            yield flush()

    ranged = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, "part int, seq int, path string, n_docs bigint, n_tokens bigint")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``base``: ids in all shards before. Two steps, so that the unpartitioned window sees one row per task only."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    totals = totals.select("part", (F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return manifest.withColumn("_inside", inside).join(totals, "part").select(*manifest.columns, (F.col("_base") + F.col("_inside")).alias("base"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read the shards that a manifest names: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document."""
    return _read(manifest, False)


def digest_shards(manifest: DataFrame) -> DataFrame:
    """As ``read_shards``, with ids_crc32 in place of the ids."""
    return _read(manifest, True)


def _read(manifest: DataFrame, digest: bool) -> DataFrame:
    def of(path: str, base: int) -> Iterable[pa.RecordBatch]:
        shard = WaveletShard(read_file(path))
        ids = shard.decode().astype("<u4")
        ends = np.cumsum(shard.lengths)
        starts = ends - shard.lengths
        pieces = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        last = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest else pa.array([p.tobytes() for p in pieces], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base), pa.array(shard.lengths), last], names=["doc_id", "start", "n_tokens", name])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from of(row["path"], row["base"])

    name, kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")
    dealt = with_starts(manifest).select("path", "base").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return dealt.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {kind}")


def token_files(df: DataFrame, path: str, end_id: int = 2, folder: str | None = None, shard_tokens: int = 4_000_000) -> DataFrame:
    """Write the shards and return their manifest, itself written, so that reading never writes again."""
    folder = folder or scratch_dir(df.sparkSession, "shards")
    return materialize(write_shards(df, path, folder, end_id, shard_tokens), "manifest")
