"""Quality rules and line dedup against their SQL and against plain recounts."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import cuckoo, line_dedup, quality, queries

LONG = "x" * 25
TEXTS = [
    None, "", " \t\n ", "a b c a b c a b c", f"{LONG}\nshort\n{LONG} ", f" {LONG.upper()}\r\nown line that stays here é", f"{LONG}\n\n{LONG}",
    "one two three four five " * 12, "w " * 60, "# $ | <a> & line\n# $ | <a> & line\nother", "é" * 20 + "\nz", "é" * 20, "q\n" + "é" * 20, "\x0bword\x0cword\x1cword", "same text twice", "same text twice",
    " ".join(f"w{i}" for i in range(80)),
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i if i != 3 else None, t, f"s{i % 3}" if i % 5 else None, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, kept string, n_chars bigint")


def same(frame, sql, spark_table):
    con = duckdb.connect()
    con.register("documents", spark_table.toPandas())
    left = frame.toPandas()
    right = con.sql(sql).df()[list(left.columns)]
    key = list(left.columns)
    left, right = (x.astype(object).where(x.notna(), None).sort_values(key, key=lambda c: c.astype(str)).values.tolist() for x in (left, right))
    assert [[str(v) for v in r] for r in left] == [[str(v) for v in r] for r in right]


def test_quality_against_sql(spark):
    docs = table(spark)
    same(quality.judge(docs.select("doc_id", "source", "text"), keep_text=False).drop("source"), queries.ORACLE_SQL["op8_quality_rules"], docs)
    assert quality.judge(table(spark, [])).count() == 0


def test_quality_against_recount(spark):
    for row in quality.judge(table(spark)).collect():
        words = (row.text or "").encode().split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        assert (row.n_words, row.n_repeat_words) == (len(words), len(covered)), row.text


def test_bad_host_goes(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 == 0 else "bad", "bad") for i in range(60)] + [(100 + i, good, f"good{i % 5}") for i in range(200)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).filter("kept").collect()}
    assert kept == set(range(100, 300))


def test_line_dedup_against_sql(spark):
    docs = table(spark)
    index = line_dedup.LineIndex.build(docs)
    same(index.digest(docs), queries.ORACLE_SQL["op6_line_dedup"], docs)
    new = {r.n_chars if r.text is None else r.doc_id: r for r in index.rewrite(docs).collect()}
    assert new[4].text == "short" and new[4].n_chars == 5 and new[4].kept == "x"
    empty = table(spark, [])
    assert line_dedup.LineIndex.build(empty).digest(empty).count() == 0


def test_line_index_is_reversible(spark):
    docs = table(spark)
    first, rest = docs.filter("doc_id < 6 or doc_id is null"), docs.filter("doc_id >= 6")
    whole = line_dedup.LineIndex.build(docs)
    grown = line_dedup.LineIndex.build(first).add(rest)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(grown.counts) == rows(whole.counts) and rows(grown.digest(docs)) == rows(whole.digest(docs))
    back = grown.remove(rest)
    alone = line_dedup.LineIndex.build(first)
    assert rows(back.counts) == rows(alone.counts) and rows(back.digest(first)) == rows(alone.digest(first))


def test_many_generations_and_shards(spark, monkeypatch):
    """Documents come and go in small steps, over several shards and a compaction; each state is as if built at once."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "GENERATIONS", 3)
    rows = lambda df: sorted(map(str, df.collect()))
    texts = [(i, "\n".join(f"a line of the kind number {k:02d}" for k in range(20) if (i * 7 + k * 3) % 5 < 2)) for i in range(24)] + [(None, "a line of the kind number 01"), (None, "a line of the kind number 01")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    part = lambda low, high: docs.filter(f"doc_id >= {low} and doc_id < {high}")
    index = line_dedup.LineIndex.build(part(0, 8))
    steps = [("add", part(8, 12), part(0, 12)), ("remove", part(2, 5), part(0, 12).filter("doc_id < 2 or doc_id >= 5")), ("add", part(2, 5), part(0, 12)), ("add", part(12, 24), part(0, 24)), ("add", docs.filter("doc_id is null"), docs), ("remove", docs.filter("doc_id is null or doc_id < 20"), part(20, 24)), ("remove", docs, docs.limit(0))]
    for step, change, now in steps:
        index = getattr(index, step)(change)
        whole = line_dedup.LineIndex.build(now)
        assert rows(index.counts) == rows(whole.counts), step
        assert rows(index.drops(docs)) == rows(whole.drops(docs)), step
    assert len(whole.filters) == 1 and index.generation == len(steps)


def test_clashing_columns(spark):
    """Columns named like those the operators use inside stay what they were."""
    names = ["_0", "_1", "_2", "_doc", "_drop", "_words", "_lines", "_grams", "_host", "rejected", "host", "shard", "_K", "_alpha"]
    docs = spark.createDataFrame([(i, t, "s", *[f"{i}{n}" for n in names]) for i, t in enumerate(TEXTS)], f"doc_id bigint, text string, source string, {', '.join(f'{n} string' for n in names)}")
    judged = quality.judge(docs)
    rewritten = line_dedup.LineIndex.build(docs).rewrite(docs)
    assert rewritten.columns == docs.columns and judged.columns[: len(docs.columns)] == docs.columns
    for out in (judged, rewritten):
        assert all(r[n] == f"{r.doc_id}{n}" for r in out.collect() for n in names) and out.count() == len(TEXTS)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9000}" for i in range(60_000)) + "\n" + "\n".join(f"line of its own number {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, long if i < 3 else "short", "s", "x", 0) for i in range(5)], "doc_id bigint, text string, source string, kept string, n_chars bigint")
    same(line_dedup.LineIndex.build(docs).digest(docs), queries.ORACLE_SQL["op6_line_dedup"], docs)
    same(quality.judge(docs.select("doc_id", "source", "text"), keep_text=False).drop("source"), queries.ORACLE_SQL["op8_quality_rules"], docs)


def test_query_and_stage_build_a_reversible_index(spark, monkeypatch):
    made = []
    build = line_dedup.LineIndex.build
    monkeypatch.setattr(line_dedup.LineIndex, "build", lambda *args, **options: made.append(build(*args, **options)) or made[-1])
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    queries.op6_line_dedup(spark, sf)
    corpus_pipeline.line_stage(spark, docs, sf)
    half = docs.filter("doc_id % 2 = 0")
    alone = build(docs.filter("doc_id % 2 <> 0"))
    for index in made:
        assert sorted(index.remove(half).counts.collect()) == sorted(alone.counts.collect())
    assert len(made) == 2


@pytest.mark.parametrize("n", [0, 1, 7, 50_000])
def test_cuckoo(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, n)
    held = cuckoo.CuckooFilter.from_bytes(cuckoo.CuckooFilter.of(high, low).to_bytes())
    assert held.contains(high, low).all()
    assert held.contains(low + 1, high).mean() < 0.01 if n > 100 else True
    half = n // 2
    held.delete(high[:half], low[:half])
    assert held.contains(high[half:], low[half:]).all()
    assert held.contains(high[:half], low[:half]).mean() < 0.01 if n > 100 else True
