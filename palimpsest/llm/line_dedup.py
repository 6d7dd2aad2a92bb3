"""Reversible line deduplication: exact reference counts by line key, with a sharded cuckoo filter in front of them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least ``min_length`` code
points count. The index keeps, in written tables,
 * ``postings``: (high, low, doc_id), one row for each document and distinct key (a 128-bit hash of the key),
 * ``counts``: (high, low, n_docs, keeper), exact; keeper is the largest doc_id that holds the key,
 * one cuckoo filter a shard over the keys of at least ``min_docs`` documents.
Adding documents writes their postings and counts as a further generation; removing documents writes their ids and anew
the counts of the keys that they held, and deletes from the filters the keys that are no longer repeated, so a later decision is as
if they had never been there. Nothing else is written again until ``GENERATIONS`` have gathered, which are then made one.

A decision asks the filter first: keys are dealt by shard, and again by document so that a very common line meets in no
one task; a task reads the filters of its shards only. Keys that pass meet the exact counts.

Contract for odd input: a null or empty text is one empty line; each row is a document of its own, so rows of equal
doc_id count apart and, if theirs is the largest doc_id, all keep the line; a null doc_id is smaller than any other; an
empty table gives an empty result; other columns pass through ``rewrite`` unchanged, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.cuckoo import SHARD_KEYS, CuckooFilter, shard_of, written_filters
from palimpsest.llm.runtime import chunks, free_names, materialize, read_file, scratch_dir, shuffle_partitions, write_file
from palimpsest.session import plain_union

WHITE = b" \t\n\x0b\x0c\r"
#: Generations that are kept apart.
GENERATIONS = 8


def line_key(line: bytes, min_length: int) -> bytes | None:
    """The 128-bit hash of a line's key, None if the key is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_length or (len(key) < 4 * min_length and not key.isascii() and len(key.decode()) < min_length):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def postings_of(df: DataFrame, min_length: int) -> DataFrame:
    """(high, low, doc_id) for each document and distinct key."""

    def run(batches):
        for batch in chunks(batches, "text"):
            keys: list[bytes] = []
            owner: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {k for line in (text or "").encode().split(b"\n") if (k := line_key(line, min_length))}
                keys += own
                owner += [i] * len(own)
            high, low = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), batch.column(0).take(pa.array(owner, pa.int64()))], names=["high", "low", "doc_id"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "high bigint, low bigint, doc_id bigint")


@functools.lru_cache(maxsize=4)
def _filter(path: str) -> CuckooFilter:
    return CuckooFilter.from_bytes(read_file(path))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; ``add`` and ``remove`` return the next one and leave this one readable.

    ``postings`` and ``counts`` hold a table for each generation that wrote one: (generation, table), and for counts
    whether they replace what older generations say of their keys. ``gone`` holds the ids that a generation removed.
    """

    postings: tuple[tuple[int, DataFrame], ...]
    counted: tuple[tuple[int, bool, DataFrame], ...]
    gone: tuple[tuple[int, DataFrame], ...]
    filters: tuple[tuple[str | None, int], ...]
    min_docs: int
    min_length: int
    generation: int = 0

    @classmethod
    def build(cls, df: DataFrame, min_docs: int = 3, min_length: int = 20) -> LineIndex:
        """Index all documents."""
        postings = materialize(postings_of(df, min_length), "postings")
        counts = materialize(_counted(postings), "line-counts")
        return cls(((0, postings),), ((0, True, counts),), (), (), min_docs, min_length)._with_filters()

    @property
    def counts(self) -> DataFrame:
        """(high, low, n_docs, keeper) as of this state."""
        if len(self.counted) == 1:
            return self.counted[0][2]
        marked = [t.withColumn("gen", F.lit(g)).withColumn("anew", F.lit(anew)) for g, anew, t in self.counted]
        by = plain_union(*marked).groupBy("high", "low").agg(F.sort_array(F.collect_list(F.struct("gen", "anew", "n_docs", "keeper"))).alias("told"))  # a row a generation at most
        none = F.struct(F.lit(0).cast("bigint").alias("n_docs"), F.lit(None).cast("bigint").alias("keeper"))
        tell = lambda s, x: F.struct(F.when(x["anew"], x["n_docs"]).otherwise(s["n_docs"] + x["n_docs"]).alias("n_docs"), F.when(x["anew"], x["keeper"]).otherwise(F.greatest(s["keeper"], x["keeper"])).alias("keeper"))
        return by.select("high", "low", F.aggregate("told", none, tell).alias("s")).select("high", "low", "s.n_docs", "s.keeper").filter("n_docs > 0")

    def _live(self) -> DataFrame:
        """The postings of documents that are not removed."""
        tables = []
        for g, table in self.postings:
            for later, ids in self.gone:
                if later > g:
                    table = table.join(ids, table["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")
            tables.append(table)
        return plain_union(*tables)

    def repeated(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs)

    def _with_filters(self) -> LineIndex:
        n = self.repeated().count()
        return replace(self, filters=written_filters(self.repeated(), max(1, -(-n // SHARD_KEYS))))

    def add(self, df: DataFrame) -> LineIndex:
        """Insert documents: their keys' counts grow; keys that become repeated enter the filters."""
        g = self.generation + 1
        new = materialize(postings_of(df, self.min_length), "postings")
        counts = materialize(_counted(new), "line-counts")
        return self._next(replace(self, generation=g, postings=(*self.postings, (g, new)), counted=(*self.counted, (g, False, counts))), counts)

    def remove(self, ids: DataFrame) -> LineIndex:
        """Delete the documents of these doc_ids (a null one too); counts and keepers of the keys they held are made anew, exactly."""
        g = self.generation + 1
        ids = materialize(ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "removed")
        live = self._live()
        held = materialize(live.join(ids, live["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("high", "low").distinct(), "removed-keys")
        following = replace(self, generation=g, gone=(*self.gone, (g, ids)))
        again = _counted(following._live().join(held, ["high", "low"], "left_semi"))
        zero = held.join(again, ["high", "low"], "left_anti").select("high", "low", F.lit(0).cast("bigint").alias("n_docs"), F.lit(None).cast("bigint").alias("keeper"))
        counts = materialize(plain_union(again, zero), "line-counts")
        return self._next(replace(following, counted=(*self.counted, (g, True, counts))), counts)

    def _next(self, following: LineIndex, told: DataFrame) -> LineIndex:
        """Bring the filters up to date: in each shard delete and insert the keys of ``told`` whose state changed.

        A filter that gets too full for its new keys is made anew from the exact counts, as are all if shards are too few.
        """
        if len(following.counted) > GENERATIONS:
            counts, postings = materialize(following.counts, "line-counts"), materialize(following._live(), "postings")
            following = replace(following, postings=((following.generation, postings),), counted=((following.generation, True, counts),), gone=())
        if following.repeated().count() > 2 * SHARD_KEYS * len(self.filters):
            return following._with_filters()
        keys = ["high", "low"]
        told = told.select(keys)
        before, after = (x.repeated().select(keys).join(told, keys, "left_semi") for x in (self, following))
        changed = plain_union(before.join(after, keys, "left_anti").withColumn("come", F.lit(False)), after.join(before, keys, "left_anti").withColumn("come", F.lit(True)))
        return replace(following, filters=_update_filters(changed, following.repeated().select(keys), self.filters, scratch_dir(told.sparkSession, "filters")))

    def passed(self, df: DataFrame) -> DataFrame:
        """(high, low, doc_id) of the keys in ``df`` that the filters let through."""
        paths, parts = [path for path, _ in self.filters], shuffle_partitions(df.sparkSession)
        salts = max(16, -(-parts // len(paths)))

        def run(batches):
            for batch in batches:
                high, low, shard = (np.asarray(batch.column(c)) for c in (0, 1, 3))
                seen = np.zeros(len(high), bool)
                for k in np.unique(shard).tolist():
                    mine = np.flatnonzero(shard == k)
                    if paths[k] is not None:
                        seen[mine] = _filter(paths[k]).contains(high[mine], low[mine])
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(seen)) for c in batch.columns[:3]], names=["high", "low", "doc_id"])

        asked = postings_of(df, self.min_length).withColumn("shard", shard_of(len(paths)))
        dealt = asked.repartition(parts, "shard", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).sortWithinPartitions("shard")
        return dealt.mapInArrow(run, "high bigint, low bigint, doc_id bigint")

    def drops(self, df: DataFrame) -> DataFrame:
        """(doc_id, high, low) of the lines that documents of ``df`` lose."""
        exact = self.repeated().select("high", "low", "keeper")
        return self.passed(df).join(exact, ["high", "low"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "high", "low")

    def _joined(self, df: DataFrame, columns: list[Column]) -> DataFrame:
        """``columns`` and then the keys that each row's document loses."""
        doc, drop = free_names(df, 2)
        drops = self.drops(df).groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias(drop)).select(F.col("doc_id").alias(doc), drop)
        return df.select(*columns).join(drops, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)), "left").drop(doc)

    def rewrite(self, df: DataFrame) -> DataFrame:
        """``df`` with the lines dropped from its texts; n_chars, where there is one, follows the new text.

        A text that loses nothing stays as it is, null included.
        """
        schema, min_length, names = df.schema, self.min_length, df.columns
        text = schema.fieldNames().index("text")
        size = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else -1

        def run(batches):
            for batch in chunks(batches, names[text]):
                drop = batch.column(batch.num_columns - 1)
                columns = list(batch.columns[:-1])
                texts = columns[text].to_pylist()
                for i, (body, gone) in enumerate(zip(texts, drop.to_pylist(), strict=True)):
                    if gone:
                        texts[i] = _kept(body, gone, min_length)[0].decode()
                columns[text] = pa.array(texts, pa.string())
                if size >= 0:
                    old = columns[size]
                    new = [len(t) if changed else n for n, changed, t in zip(old.to_pylist(), drop.is_valid().to_pylist(), texts, strict=True)]
                    columns[size] = pa.array(new, old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return self._joined(df, [F.col(c) for c in df.columns]).mapInArrow(run, schema)

    def digest(self, df: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
        min_length = self.min_length

        def run(batches):
            for batch in chunks(batches, "text"):
                lines, dropped, digests = [], [], []
                for body, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if gone:
                        kept, n, lost = _kept(body, gone, min_length)
                    else:
                        kept = (body or "").encode()
                        n, lost = kept.count(b"\n") + 1, 0
                    lines.append(n)
                    dropped.append(lost)
                    digests.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

        return self._joined(df, [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")]).mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def _kept(body: str, gone: list[dict], min_length: int) -> tuple[bytes, int, int]:
    """(text without the lines of these keys, lines before, lines dropped)."""
    drop = {x["high"].to_bytes(8, "little", signed=True) + x["low"].to_bytes(8, "little", signed=True) for x in gone}
    lines = body.encode().split(b"\n")
    kept = [line for line in lines if line_key(line, min_length) not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _update_filters(changed: DataFrame, repeated: DataFrame, filters: tuple, folder: str) -> tuple[tuple[str | None, int], ...]:
    """Filters after the changes; those that can't take their new keys are made anew from ``repeated``."""
    shards = len(filters)

    def run(key, change):
        import pandas as pd

        come = change["come"].to_numpy(bool)
        high, low = change["high"].to_numpy(), change["low"].to_numpy()
        held = _from(filters[key[0]][0])
        if held is not None:
            held.delete(high[~come], low[~come])
        if held is None or not held.insert(high[come], low[come]):
            return pd.DataFrame({"shard": [key[0]], "path": [None], "size": [0]})
        data = held.to_bytes()
        return pd.DataFrame({"shard": [key[0]], "path": [write_file(folder, f"filter-{key[0]:06d}", data)], "size": [len(data)]})

    made = changed.select("high", "low", "come", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(run, "shard int, path string, size bigint")
    found = {r.shard: (r.path, r.size) for r in made.collect()}  # one short row a shard
    if full := [k for k, (path, _) in found.items() if path is None]:
        anew = written_filters(repeated.filter(shard_of(shards).isin(full)), shards)
        found |= {k: anew[k] for k in full}
    return tuple(found.get(k, old) for k, old in enumerate(filters))


def _from(path: str | None) -> CuckooFilter | None:
    return None if path is None else CuckooFilter.from_bytes(read_file(path))


DIGEST_SQL = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}
), lines AS (
  SELECT rid, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM rows_)
), keys AS (
  SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT rid, doc_id, k FROM lines WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3
), marked AS (
  SELECT lines.*, keys.k IS NOT NULL AND lines.doc_id IS DISTINCT FROM keys.keeper AS gone FROM lines LEFT JOIN keys ON lines.k = keys.k
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
