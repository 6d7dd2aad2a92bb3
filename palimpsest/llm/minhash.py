"""Near-duplicate groups: universal hash minima in bands, signatures, exact confirmation, connected components.

A text's set holds its distinct shingles of ``words`` words (A-Z lower-cased); texts of fewer words have one shingle, the
whole sequence; texts without words have none and link with nothing. Two sets link if 100 * |A & B| >= percent * |A | B|.

 1. Each text gets ``bands * rows`` minima of hashes h(x) = a x + b mod 2**64, a bucket key for each band, eight bits of
    each minimum as signature, and a 128-bit fingerprint of its set. Equal sets are one class from here on.
 2. Each bucket of several classes has a hub, the class that meets most others in all its buckets. Every class is paired
    with the hubs of its buckets only; the signatures and then the full sets decide which of them link, and the
    links' components are found.
 3. A hub's classes may still lie in several components, and two of them may link although neither links with the hub.
    Relative to the hub h a class a is |a & h| and its extras a - h, and |a & b| <= min(|a & h|, |b & h|) + |extras in
    common|. First, classes leave whose own bound, with the extras that occur in any other class of this hub, is too
    low; they are proven to have no link. Then classes outside the hub's largest component meet all others in blocks of
    bounded size: the extras in common are counted, and only pairs that could still link leave the block, to be confirmed like
    the others. Pairs inside one component can't change it and never leave a block.

So every link between classes in a common bucket counts. With 32 bands of 4, sets of similarity 0.8 meet in no bucket
once in twenty million; a signature of 128 agrees on too few bytes for such a pair once in a billion. Shingles are compared
by 64-bit hashes. The work in blocks grows with the product of a hub's classes in and outside its largest component
that the first bound leaves, divided among as many tasks; rows do not.

Contract for odd input: null texts count as empty; rows of a null doc_id take part, and a group of such rows alone has a
null component_id; rows of equal doc_id are rows of their own; an empty table gives an empty result; other columns are
ignored by ``groups`` and pass through ``representatives`` unchanged, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.components import components
from palimpsest.llm.cuckoo import SHARD_KEYS, CuckooFilter, written_filters
from palimpsest.llm.runtime import chunks, discard, free_names, materialize, read_file, shuffle_partitions, text_bytes
from palimpsest.llm.textops import mix, shingle_hashes, word_hashes
from palimpsest.session import plain_union

#: Classes, and extras, on either side of a block, on average.
BLOCK_CLASSES, BLOCK_EXTRAS = 1024, 1 << 20
#: Pairs that are counted at once.
TILE = 1 << 19
#: Keys (of about 2.4 bytes each) that a filter read by every task may hold.
FILTER_KEYS = 20_000_000
#: Shingles hashed at once; 128 passes over this many stay in a core's cache.
BLOCK = 1 << 16


@functools.cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8191))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[sets, n] smallest hash values; sets must not be empty."""
    a, b = _coefficients(n)
    out = np.full((len(sets), n), np.iinfo(np.uint64).max, np.uint64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush():
        x = np.concatenate(held)
        starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
        rows = np.array(owners)
        for j in range(n):
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(x * a[j] + b[j], starts))
        held.clear()
        owners.clear()

    for i, s in enumerate(sets):
        for at in range(0, len(s), BLOCK):  # a long set comes in parts; a part never meets another of its own set in a flush
            if size and (size + len(s) > BLOCK or at):
                flush()
                size = 0
            held.append(s[at : at + BLOCK])
            owners.append(i)
            size += len(held[-1])
    if held:
        flush()
    return out


def signatures(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tkey, dkey (hashes of the text, and of doc_id with it), n_shingles, fp, sig, bands of each row; fp, sig and bands are null for empty sets."""

    def run(batches):
        for batch in chunks(batches, "text"):
            sets = shingle_hashes(*word_hashes(*text_bytes(batch.column(3))), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            low = minima([sets[i] for i in full], bands * rows)
            sig = (mix(low) >> np.uint64(56)).astype(np.uint8)
            keys = np.zeros((len(full), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::rows])
            prints: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            buckets: list[np.ndarray | None] = [None] * len(sets)
            for k, i in enumerate(full.tolist()):
                prints[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                sigs[i] = sig[k].tobytes()
                buckets[i] = keys[k].view(np.int64)
            arrays = [*batch.columns[:3], pa.array(sizes), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tkey", "dkey", "n_shingles", "fp", "sig", "bands"])

    return _keyed(df).mapInArrow(run, "doc_id bigint, tkey bigint, dkey bigint, n_shingles bigint, fp binary, sig binary, bands array<bigint>")


def _keyed(df: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return df.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("tkey"), F.xxhash64(F.lit(1), doc_id, "text").alias("dkey"), "text")


@F.pandas_udf(T.IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Signature bytes that agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
    return pd.Series((left == right).sum(1).astype(np.int32))


def _classes(marked: DataFrame) -> DataFrame:
    """id, fp, doc_id, tkey, dkey, n, sig, bands: one row for each distinct set, with its first document. To be written before use."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "dkey")).alias("m")
    equal = [F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")]  # rows of one fp agree on these
    one = marked.filter("n_shingles > 0").groupBy("fp").agg(least, *equal)
    return one.select(F.monotonically_increasing_id().alias("id"), "fp", "m.doc_id", "m.tkey", "m.dkey", F.col("n_shingles").alias("n"), "sig", "bands")


def _sets(df: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, n, sig, shingles) of the classes in ``wanted`` (tkey, dkey, id, n, sig; written): one document of each is read again.

    Tasks pass over texts that a filter of the wanted keys does not hold, so only wanted sets are shuffled. Beyond
    FILTER_KEYS keys the filter would be too large to be read by every task; texts then meet the keys in a join first.
    """

    def run(batches):
        for batch in chunks(batches, "text"):
            if filters:
                batch = batch.filter(pa.array(_wanted(filters, *(np.asarray(batch.column(c)) for c in (0, 1)))))
            if batch.num_rows:
                sets = shingle_hashes(*word_hashes(*text_bytes(batch.column(2))), words)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["tkey", "dkey", "shingles"])

    keys = ["tkey", "dkey"]
    texts = _keyed(df).select("tkey", "dkey", "text")
    n = wanted.count()
    filters = written_filters(wanted.select(F.col("tkey").alias("high"), F.col("dkey").alias("low")), max(1, -(-n // SHARD_KEYS))) if n <= FILTER_KEYS else ()
    filters = [path for path, _ in filters]
    if not filters:
        texts = texts.join(wanted.select(*keys), keys, "left_semi")
    found = texts.mapInArrow(run, "tkey bigint, dkey bigint, shingles array<bigint>")
    return found.join(wanted, keys).dropDuplicates(keys).select("id", "n", "sig", "shingles")


@functools.lru_cache(maxsize=2)
def _read_filters(paths: tuple) -> list[CuckooFilter | None]:
    return [None if path is None else CuckooFilter.from_bytes(read_file(path)) for path in paths]


def _wanted(paths: list[str | None], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    held = _read_filters(tuple(paths))
    shard = np.mod(high, len(held))
    out = np.zeros(len(high), bool)
    for k, own in enumerate(held):
        mine = np.flatnonzero(shard == k)
        if own is not None and len(mine):
            out[mine] = own.contains(high[mine], low[mine])
    return out


def _hub_rows(multi: DataFrame, leaders: int) -> DataFrame:
    """(hub, id) of every class with the hubs of its buckets: the ``leaders`` classes of a bucket that meet most others in all buckets."""
    weight = multi.groupBy("id").agg(F.sum("size").alias("w"))
    weighed = multi.join(weight, "id")
    first = F.max(F.struct("w", "id"))["id"]
    others = [F.max_by("id", F.xxhash64(F.lit(k), "id")) for k in range(1, leaders)]
    led = weighed.groupBy("bucket").agg(F.array_distinct(F.array(first, *others)).alias("hubs"))
    return multi.join(led, "bucket").select(F.explode("hubs").alias("hub"), "id").distinct()


class _Test:
    """What makes a link, as columns."""

    def __init__(self, percent: int, hashes: int):
        self.percent = percent
        share = percent / 100
        #: Six standard deviations below what sets at the threshold agree on.
        self.least = int(hashes * share - 6 * (hashes * share * (1 - share)) ** 0.5)

    def sized(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def enough(self, inter: Column, a: str, b: str) -> Column:
        return (100 + self.percent) * inter >= self.percent * (F.col(a) + F.col(b))


def _measured(rows: DataFrame, sets: DataFrame, test: _Test) -> DataFrame:
    """(hub, id, n, nh, inter, link, extras) of pairs (hub, id): their sets' intersection, whether they link, and id's shingles that the hub lacks."""
    one = sets.select(F.col("id").alias("hub"), F.col("n").alias("nh"), F.col("sig").alias("sh"), F.col("shingles").alias("xh"))
    one = one.join(rows.select("hub").distinct(), "hub", "left_semi")
    both = rows.join(sets, "id").join(one, "hub").withColumn("same", _agreement("sig", "sh"))
    extras = F.array_except("shingles", "xh")
    both = both.select("hub", "id", "n", "nh", "same", extras.alias("extras")).withColumn("inter", F.col("n") - F.size("extras"))
    link = (F.col("hub") != F.col("id")) & test.sized("n", "nh") & (F.col("same") >= test.least) & test.enough(F.col("inter"), "n", "nh")
    return both.select("hub", "id", "n", "nh", "inter", link.alias("link"), "extras")


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, test: _Test) -> DataFrame:
    """Of pairs (a, b), those that link: by size and signature first, then on full sets."""
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    close = pairs.join(one, "a").join(two, "b").filter(test.sized("na", "nb"))
    close = close.withColumn("same", _agreement("sa", "sb")).filter(F.col("same") >= test.least).select("a", "b", "na", "nb")
    both = close.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    inter = F.size(F.array_intersect("xa", "xb")).cast("bigint")
    return both.filter(test.enough(inter, "na", "nb")).select("a", "b")


def _open_rows(measured: DataFrame, roots: DataFrame, test: _Test) -> DataFrame:
    """(hub, id, n, inter, comp, extras, outer) of hubs whose classes lie in several components, without classes proven to have no link.

    ``extras`` holds only what occurs in another class of the hub; ``outer`` marks classes outside the hub's largest component.
    """
    placed = measured.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
    placed = materialize(placed.select("hub", "id", "n", "inter", "comp", "extras"), "placed")
    parts = placed.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("c"))
    whole = parts.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp"))["comp"].alias("big")).filter("k > 1").select("hub", "big")
    items = placed.select("hub", "id", F.explode("extras").alias("item")).join(whole.select("hub"), "hub", "left_semi")
    common = items.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("hub", "item")
    shared = items.join(common, ["hub", "item"]).groupBy("hub", "id").agg(F.collect_list("item").alias("extras"))
    rows = placed.select("hub", "id", "n", "inter", "comp").join(whole, "hub").join(shared, ["hub", "id"], "left")
    rows = rows.withColumn("extras", F.coalesce("extras", F.array().cast("array<bigint>")))
    able = 100 * (F.col("inter") + F.size("extras")) >= test.percent * F.col("n")
    out = materialize(rows.filter(able).select("hub", "id", "n", "inter", "comp", "extras", (F.col("comp") != F.col("big")).alias("outer")), "open")
    discard(placed)
    return out


def block_pairs(outer: pd.DataFrame, every: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in outer, in every) of the pairs of one hub and different components that could link, by the extras they have in common.

    Pairs are counted in tiles of ``TILE`` at most, so memory follows the rows, not the pairs.
    """
    def columns(f: pd.DataFrame) -> tuple:
        extras = np.concatenate([np.asarray(x, np.int64) for x in f["extras"]] or [np.zeros(0, np.int64)])
        ends = np.cumsum([0, *map(len, f["extras"])])
        hub, n, inter, comp = (f[c].to_numpy(np.int64) for c in ("hub", "n", "inter", "comp"))
        owner = np.repeat(np.arange(len(f)), np.diff(ends))
        return hub, n, inter, comp, mix(extras.view(np.uint64) + mix(hub[owner].view(np.uint64))), owner, ends

    ha, na, ia, ca, mine, owner, ends = columns(outer)
    hb, nb, ib, cb, theirs, holder, _ = columns(every)
    order = np.argsort(theirs, kind="stable")
    theirs, holder = theirs[order], holder[order]
    found = []
    step = max(1, TILE // max(1, len(nb)))
    for x in range(0, len(na), step):
        y = min(x + step, len(na))
        own = slice(int(ends[x]), int(ends[y]))
        low, high = np.searchsorted(theirs, mine[own], "left"), np.searchsorted(theirs, mine[own], "right")
        common = _common(owner[own] - x, low, high - low, holder, y - x, len(nb))
        bound = common + np.minimum(ia[x:y, None], ib)
        apart = (ca[x:y, None] != cb) & (ha[x:y, None] == hb)
        sized = 100 * np.minimum(na[x:y, None], nb) >= percent * np.maximum(na[x:y, None], nb)
        i, j = np.nonzero(apart & sized & ((100 + percent) * bound >= percent * (na[x:y, None] + nb)))
        found.append((i + x, j))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _common(owner: np.ndarray, low: np.ndarray, many: np.ndarray, holder: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """[rows, columns] extras in common: each extra of a row meets ``many`` postings in ``holder`` from ``low`` on."""
    out = np.zeros(rows * columns, np.int32)
    ends = np.cumsum(many)
    at = 0
    while at < len(owner):  # as many postings at once as there are pairs in a tile
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
        own = many[at:to]
        reach = np.repeat(low[at:to] - np.cumsum(own) + own, own) + np.arange(int(own.sum()))
        np.add.at(out, np.repeat(owner[at:to] * columns, own) + holder[reach], 1)
        at = to
    return out.reshape(rows, columns)


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of classes of one hub and different components that could link. ``rows`` are open rows, written.

    A large hub's rows are dealt to blocks, and each block of outer ones meets each block of all; small hubs share blocks.
    """
    many = lambda count, extras: F.greatest(F.ceil(count / BLOCK_CLASSES), F.ceil(extras / BLOCK_EXTRAS), F.lit(1)).cast("int")
    size = F.size("extras").cast("bigint")
    sums = rows.groupBy("hub").agg(F.count_if("outer").alias("no"), F.sum(F.when(F.col("outer"), size).otherwise(0)).alias("eo"), F.count(F.lit(1)).alias("ne"), F.sum(size).alias("ee"))
    shared = max(1, -(-rows.count() // (BLOCK_CLASSES // 2 or 1)))
    sums = sums.filter("no > 0").select("hub", many(F.col("no"), F.col("eo")).alias("bo"), many(F.col("ne"), F.col("ee")).alias("be"))
    small = (F.col("bo") == 1) & (F.col("be") == 1)
    dealt = rows.join(sums.withColumn("g", F.when(small, -1 - F.pmod(F.xxhash64("hub"), F.lit(shared))).otherwise(F.col("hub"))), "hub")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["hub", "id", "n", "inter", "comp", "extras"]
    outer = dealt.filter("outer").select("g", own("bo").alias("i"), each("be").alias("j"), *held)
    every = dealt.select("g", each("bo").alias("i"), own("be").alias("j"), *held).toDF("g", "i", "j", *held)

    def run(left, right):
        i, j = block_pairs(left, right, percent) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int))
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    parts = shuffle_partitions(rows.sparkSession)  # few bytes but much work: not to be gathered into few tasks
    outer, every = (x.repartition(parts, "g", "i", "j").groupBy("g", "i", "j") for x in (outer, every))
    return outer.cogroup(every).applyInPandas(run, "a bigint, b bigint").distinct()


def groups(df: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, leaders: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, tkey (hash of the text) for every row of ``df``."""
    test = _Test(percent, bands * rows)
    marked = materialize(signatures(df, words, bands, rows), "signatures")
    classes = materialize(_classes(marked), "classes")
    places = classes.select("id", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    multi = materialize(places.join(shared, "bucket"), "buckets")
    pairs = materialize(_hub_rows(multi, leaders), "hubs")
    discard(multi)
    wanted = materialize(classes.select("tkey", "dkey", "id", "n", "sig").join(pairs.select("id").distinct(), "id", "left_semi"), "wanted")
    sets = materialize(_sets(df, wanted, words), "sets")
    measured = materialize(_measured(pairs, sets, test), "measured")
    roots = components(measured.filter("link").select(F.col("hub").alias("u"), F.col("id").alias("v")))
    open_ = _open_rows(measured, roots, test)
    more = materialize(_confirmed(materialize(_block_pairs(open_, percent), "pairs"), classes, sets, test), "links")
    if more.limit(1).count():
        roots = components(plain_union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")), more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    discard(pairs, wanted, sets, measured, open_, more)

    # the smallest doc_id of each component, by class; then every row takes that of its class
    linked = classes.select("id", "fp", "doc_id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("fp", "doc_id", F.coalesce("root", "id").alias("root"))
    linked = materialize(linked, "roots")
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = linked.join(smallest, "root").select("fp", "component_id")
    out = marked.select("doc_id", "tkey", "n_shingles", "fp").join(label, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tkey")


def representatives(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that stay: of each group those of the smallest doc_id."""
    own, doc, key = free_names(df, 3)
    kept = groups(df, **options).filter("kept").select(F.col("doc_id").alias(doc), F.col("tkey").alias(key)).distinct()
    keyed = df.withColumn(own, F.xxhash64("text"))
    return keyed.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left_semi").drop(own)
