"""Archives, top-k, packing, toxicity and the pipeline: against plain versions, on small tables with odd rows."""

import hashlib
import math
import operator
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import minhash, packing, queries, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = queries._path("word_bpe_49k.json")


def test_archives(spark):
    big, other = "<p>é</p>" * 40, "x" * 300
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", other), (None, "u", big), (None, "u", "z" * 200), (None, "u", "z" * 200), (1, "again", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(map(str, warc.read_archives(warc.write_archives(df, file_bytes=500), with_payload=True).drop("url").collect()))
    want = []
    for p, _, html in rows:
        body = (html or "").encode()
        same = [q for q, _, h in rows if (h or "").encode() == body and q is not None]
        first = min(same) if same and len(body) >= 100 and sum((h or "").encode() == body for _, _, h in rows) > 1 else None
        revisit = first is not None and p != first
        want.append(f"Row(page_id={p}, payload_bytes={len(body)}, payload_digest='{hashlib.sha256(body).hexdigest()}', record_type='{'revisit' if revisit else 'response'}', refers_to={first if revisit else None}, payload={(b'' if revisit else body)!r})")
    assert got == sorted(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    records = [f"record {i} ".encode() * (i + 1) for i in range(50)]
    assert list(warc.unpack_file(warc.pack_file(records))) == records and list(warc.unpack_file(warc.pack_file([]))) == []


def plain_top(rows, k, scale):
    """Exact integers; of a repeated query id the smallest vector asks; scores are given as the nearest long."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wholes = [(i, [math.floor(Fraction(float(x)) * scale) for x in v]) for i, v in fine]
    want = []
    for i in sorted({i for i, _ in fine if i % 50 == 0}):
        _, q = min((v, w) for (j, v), (_, w) in zip(fine, wholes, strict=True) if j == i)
        scored = sorted((-sum(map(operator.mul, q, w)), j) for j, w in wholes if j != i and len(w) == len(q))
        want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scored[:k])]
    return sorted(want)


def top_rows(df, *options):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0, *options).collect())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.2, 16).astype("float32").tolist() for _ in range(300)]
    vectors[7] = vectors[8] = vectors[9] = vectors[50]
    rows = list(enumerate(vectors)) + [(300, None), (301, []), (350, [float("nan")] * 16), (351, [None] * 16), (400, [1.0, 2.0]), (401, [0.5, -1.0]), (None, vectors[0]), (50, vectors[50]), (402, [3.0e5, 1.0]), (450, []), (50, vectors[51])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    con = duckdb.connect()
    con.register("embeddings", df.drop("score").toPandas())
    for k, scale, blocks in ((5, 256, (64, 2)), (3, 256, (8192, 512))):
        assert top_rows(df, k, scale, *blocks) == plain_top(rows, k, scale)
    assert sorted(con.sql(topk.SEARCH_SQL.format(embeddings="embeddings")).select("query_id, rank, vec_id, score").fetchall()) == plain_top(rows, 5, 256)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_any_finite_size(spark):
    rows = [(0, [1.0, 1.0]), (1, [300000.0, 1.0]), (2, [0.5, 0.5]), (100, [1.0, 2.0]), (100, [2.0, 1.0]), (3, [1e30, 1.0]), (4, [1e30, -1.0]), (5, [-1e30, 3.0]), (6, [1e300, 1e-300]), (150, [1e30, 1e30]), (200, [-1e308, 1.7e308]), (250, [0.0, 0.0])]
    rows += [(1000 + i, [float(x), float(y)]) for i, (x, y) in enumerate(np.random.default_rng(1).normal(0, 1e20, (200, 2)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for blocks in ((8192, 512), (16, 3)):
        assert top_rows(df, 5, 256, *blocks) == plain_top(rows, 5, 256)


def test_top_k_of_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 3, 5000).tolist()) for i in range(0, 120, 10)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert top_rows(df, 5, 256) == plain_top([(i, [float(256 * x) / 256 for x in v]) for i, v in rows], 5, 256)


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.best_fit(lengths, 100)
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        used = np.bincount(bins, weights=lengths) if n else np.zeros(0)
        assert (used <= 100).all() and len(used) >= bound >= -(-int(lengths.sum()) // 100)
        for b in range(len(used)):
            own = np.argsort(offsets[bins == b])
            assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == offsets[bins == b][own]).all()
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10


def packed_is_right(rows, texts, size):
    library = Tokenizer.from_file(WORD)
    want = []
    for d, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by), packing.lower_bound(np.bincount([r.length for r in rows], minlength=size + 1), size)


def test_packing(spark, monkeypatch):
    rnd = random.Random(9)
    texts = [(i, " ".join(rnd.choice(["word", "other", "tokens", "x"]) for _ in range(rnd.choice([0, 1, 5, 20, 40, 63, 64, 130])))) for i in range(400)] + [(None, "null id"), (None, None), (5, "again"), (5, "again"), (6, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("part", F.lit("clash")).withColumn("length", F.lit(0))
    for pieces in (40_000, 60):
        monkeypatch.setattr(packing, "PART_PIECES", pieces)
        used, bound = packed_is_right(packing.packed_documents(df, WORD, size=64).collect(), texts, 64)
        assert used <= bound + 3
    assert packing.packed_documents(df.limit(0), WORD).count() == 0
    whole = packing.sequences(df.filter("doc_id < 50"), WORD, size=64)
    assert all(r.n_tokens * 4 == len(r.ids) for r in whole.collect())


def test_very_long_texts(spark, machine):
    """A text far larger than a chunk: cut into pieces that fill sequences, archived whole, and scored by all its terms."""
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["word", "other", "tokens", "x"]) for _ in range(700_000))
    texts = [(1, long), (2, "short one"), (3, long[:100_000])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    used, bound = packed_is_right(packing.packed_documents(df, WORD).collect(), texts, 4096)
    assert used == bound
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "short")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert [got[i].payload_bytes for i in (1, 2, 3)] == [len(long), len(long), 5] and got[2].refers_to == 1
    assert got[1].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    at_end = spark.createDataFrame([(1, long + " you idiot"), (2, "word other tokens x you idiot")], "doc_id bigint, text string")
    scores = [r.score for r in toxicity.score(at_end, machine).orderBy("doc_id").collect()]
    assert abs(scores[0] - scores[1]) < 1e-12 and scores[0] > 0.3


def test_gaps_choose_the_exchange(spark, monkeypatch):
    """Parts without a gap stay whole, parts with one give up full bins too; open bins of certified parts come last."""
    monkeypatch.setattr(packing, "PART_PIECES", 40)
    dealt = []
    monkeypatch.setattr(packing, "materialize", lambda df, label, write=packing.materialize: dealt.append(write(df, label)) or dealt[-1])
    rng = np.random.default_rng(6)
    items = [(i, 0, int(n), i) for i, n in enumerate(rng.integers(9, 60, 1500))]
    df = spark.createDataFrame(items, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint")
    rows = packing.pack(df, 100).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(d, n) for d, _, n, _ in items]
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 100
    first, second = (f.collect() for f in dealt[:2])
    assert {r.gap > 0 for r in first} == {True, False} and not all(r.open for r in first if r.gap)
    assert sorted(r.doc_id for r in second) == sorted(r.doc_id for r in first if r.gap)


def test_exchange_until_the_bound(spark, monkeypatch):
    """Hundreds of parts are joined as long as that gains something, not three times."""
    monkeypatch.setattr(packing, "PART_PIECES", 4)
    df = spark.createDataFrame([(i, 0, 10, i) for i in range(2400)], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint")
    assert packing.pack(df, 100).select("sequence_id").distinct().count() == 240


@pytest.fixture(scope="module")
def machine(spark):
    return queries.toxicity_machine(spark, SF.replace("0.001", "0.1"))


def test_toxicity_on_held_out(spark, machine):
    sf = SF.replace("0.001", "0.1")
    scored = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), machine)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    clean = [r for r in rows if r.toxic == 0]
    assert hit > 0.93 and sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_against_the_sum_over_pairs(spark, machine):
    """Scores recomputed plainly: distinct terms of a text by regular expressions, and every pair of them."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    df = spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, machine).collect()}
    place = {int(p): k for k, p in enumerate(machine.places)}
    seen = {}

    def hashed(run):
        if run not in seen:
            raw = np.frombuffer(run, np.uint8)
            seen[run] = set(toxicity.terms(raw, np.array([0, len(raw)]))[0].tolist())
        return seen[run]

    pairs = 0
    for r in docs:
        runs = set(re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())))
        own = sorted({place[t] for run in runs for t in hashed(run) if t in place})
        value = machine.bias + sum(machine.weights[i] for i in own)
        for k, i in enumerate(own):
            for j in own[:k]:
                value += float(machine.factors[i] @ machine.factors[j])
                pairs += 1
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-40, min(40, value))))) < 1e-9
    assert pairs > 100


def test_toxicity_odd_rows(spark, machine):
    rows = [(1, None), (None, ""), (1, "you idiot " * 50), (4, "plain words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("lang", F.lit("en"))
    got = toxicity.score(df, machine).collect()
    assert len(got) == 4 and all(r.score is not None for r in got) and max(r.score for r in got) > 0.3 > got[0].score
    assert toxicity.score(df.limit(0), machine).count() == 0 and toxicity.clean(df, machine).columns == df.columns
    none = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert [bool(r.h) for r in df.select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()] == [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows]


def test_pairs_count_in_the_machine():
    """An interaction that linear weights cannot express: both terms together, neither alone."""
    rng = np.random.default_rng(0)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    rows = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    terms = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    order = np.lexsort((terms, rows))
    w, v, bias = toxicity._fit(rows[order], terms[order], (a != b).astype(float), 2, 4, 1500, 0.02, 1e-4)
    m = toxicity.Machine(np.array([0, 1]), w, v, bias)
    p = toxicity._sigmoid(m.raw(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 4))
    assert p[0] > 0.8 and p[1] > 0.8 and p[2] < 0.2 and p[3] < 0.2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        before = {r.doc_id for r in docs.collect()}
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in out.collect()} <= before
        if name == "near-duplicates":
            assert minhash.groups(out).filter("not kept").count() == 0
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    used, bound = packed_is_right(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert used <= bound + 1
    assert sorted(map(str, [(r.doc_id, r.piece, r.ids_crc32) for r in rows])) == sorted(map(str, [(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()]))
