"""A cuckoo filter over 128-bit keys, with bulk insertion: 16-bit fingerprints, four to a bucket, deletable.

Keys of a filter are distinct (a key inserted twice takes two places and must be deleted twice); a filter without keys
holds none. A key that was never inserted is found once in some ten thousand times.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import scratch_dir, write_file
from palimpsest.llm.textops import mix

#: Keys to a shard of a filter, on average.
SHARD_KEYS = 200_000

SLOTS = 4
_HEAD = struct.Struct("<4sI")
_MAGIC = b"CKO1"


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> CuckooFilter:
        """A filter that holds these distinct keys; it doubles until all find a place."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1.0, len(high) / (SLOTS * 0.85))))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.insert(high, low):
                return made
            buckets *= 2

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (mix(low.astype(np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, mix(high.astype(np.int64).view(np.uint64)) & self.mask

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & self.mask)

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Insert keys; False if they do not fit (the filter is then to be made anew, larger)."""
        prints, bucket = self._places(high, low)
        moved = np.zeros(len(prints), bool)
        rng = np.random.default_rng(len(prints))
        for _ in range(400):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket, moved = prints[order], bucket[order], moved[order]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            start = np.flatnonzero(first)
            rank = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            at = bucket.astype(np.int64)
            used = (self.table[at] != 0).sum(1)
            fits = rank < SLOTS - used
            self.table[at[fits], (used + rank)[fits]] = prints[fits]  # filled slots come first in a bucket
            prints, bucket, moved = prints[~fits], bucket[~fits], moved[~fits]
            swap = np.flatnonzero(moved)
            if len(swap):  # both buckets were full: one key a bucket takes a slot, its old print moves on
                _, once = np.unique(bucket[swap], return_index=True)
                swap = swap[once]
                rows, slots = bucket[swap].astype(np.int64), rng.integers(0, SLOTS, len(swap))
                prints[swap], self.table[rows, slots] = self.table[rows, slots].copy(), prints[swap]
            bucket = self._other(prints, bucket)
            moved = np.ones(len(prints), bool)
        return not len(prints)

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        prints, bucket = self._places(high, low)
        found = (self.table[bucket.astype(np.int64)] == prints[:, None]).any(1)
        return found | (self.table[self._other(prints, bucket).astype(np.int64)] == prints[:, None]).any(1)

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Delete keys that were inserted before."""
        prints, bucket = self._places(high, low)
        other = self._other(prints, bucket)
        for p, a, b in zip(prints.tolist(), bucket.astype(np.int64).tolist(), other.astype(np.int64).tolist(), strict=True):
            for row in (a, b):
                held = self.table[row].tolist()
                if p in held:
                    held.remove(p)
                    self.table[row] = [*[x for x in held if x], *[0] * (SLOTS - len([x for x in held if x]))]
                    break

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, len(self.table)) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        magic, buckets = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a cuckoo filter")
        return cls(np.frombuffer(data, "<u2", offset=_HEAD.size).reshape(buckets, SLOTS).copy())


def shard_of(shards: int) -> Column:
    return F.pmod("high", F.lit(shards)).cast("int")


def written_filters(keys: DataFrame, shards: int) -> tuple[tuple[str | None, int], ...]:
    """(path, bytes) of a filter for each shard of the distinct ``keys`` (high, low); a shard without keys has none."""
    folder = scratch_dir(keys.sparkSession, "filters")

    def run(key, frame):
        import pandas as pd

        data = CuckooFilter.of(frame["high"].to_numpy(), frame["low"].to_numpy()).to_bytes()
        return pd.DataFrame({"shard": [key[0]], "path": [write_file(folder, f"filter-{key[0]:06d}", data)], "size": [len(data)]})

    made = keys.select("high", "low", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(run, "shard int, path string, size bigint")
    found = {r.shard: (r.path, r.size) for r in made.collect()}  # one short row a shard
    return tuple(found.get(k, (None, 0)) for k in range(shards))
