"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import decimal
import hashlib
import math

import duckdb
import pytest

from palimpsest.functions import stems, text, tokens
from palimpsest.operators import state
from palimpsest.plans import catalogue, states
from palimpsest.sources import pages, tables

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (float, decimal.Decimal)):
        return str(v)
    return f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    right = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(right.columns)
    rows = lambda data, names: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in data)
    assert rows(df.collect(), df.columns) == rows(right.fetchall(), right.columns)


def rows_of(df):
    return sorted(str({c: plain(v) for c, v in r.asDict().items()}) for r in df.collect())


REPLAYS = {
    "geometric_clusters": (states.cluster_input, "key", ("ts", "id"), lambda s, r: state.cluster_step(s, r, 0.65, 7.0)),
    "profile_merge_replay": (states.profile_input, "owner_id", ("arrival",), state.profile_step),
    "pending_replay": (states.pending_input, "owner_id", ("ts", "seq"), state.pending_step),
    "skill_ops_replay": (states.skill_input, "key", ("seq",), state.skill_step),
}


@pytest.mark.parametrize("name", sorted(REPLAYS))
def test_replays_against_one_walk(spark, name):
    """Row by row, the step functions over each key's rows in order, on the driver."""
    make, key, order, step = REPLAYS[name]
    rows = sorted((r.asDict(recursive=True) for r in make(spark, SF).collect()), key=lambda r: (str(r[key]), *(r[c] for c in order)))
    want, now = [], {}
    for r in rows:
        now[r[key]], out = step(now.get(r[key], {}), r)
        want += [str({c: plain(v) for c, v in o.items()}) for o in out]
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == sorted(want)


def test_texts_against_plain_functions(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalogue.QUERIES["text_widths"](spark, SF).collect():
        t = docs[r.doc_id]
        assert r.width == text.width_of(t or "") and r.summary == (None if t is None else text.cut_summary(t))
        assert r.folded == (None if t is None else hashlib.md5(text.fold_text(t).encode()).hexdigest())
    assert {r.doc_id: r.n_tokens for r in catalogue.QUERIES["token_estimates"](spark, SF).collect()} == {d: tokens.estimate(t or "") for d, t in docs.items()}
    cut = {r.doc_id: r.digest for r in catalogue.QUERIES["truncated_texts"](spark, SF).collect()}
    assert cut == {d: None if t is None else hashlib.md5(tokens.truncated(t, 60).encode()).hexdigest() for d, t in docs.items()}


def test_items_are_trimmed_to_their_caps(spark):
    kept = {(r.conv_id, r.pos): r.digest for r in catalogue.QUERIES["trimmed_items"](spark, SF).collect()}
    held = {}
    for r in tables.items(spark, SF).collect():
        held.setdefault(r.conv_id, []).append(r)
    for own in held.values():
        size = sum(len(r.content) for r in own) * 100
        trigger = 50_000 if len(own) > 100 else 100_000
        f = trigger / size if size > trigger else 1
        for r in own:
            cap = max(200, int(1000 * f)) if r.kind == "tool_result" else max(200, int(800 * f)) if r.kind == "tool_call" else max(500, int(3000 * f))
            want = r.content if r.kind == "text" and r.role != "assistant" else tokens.truncated(r.content, int(cap / 20))
            assert kept[r.conv_id, r.pos] == hashlib.md5(want.encode()).hexdigest()


def test_stems_of_all_documents(spark):
    """Terms recounted from words by the plain stemmer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {}
    for r in docs.select("doc_id", stems.words(docs["text"]).alias("w")).collect():
        for w in r.w:
            want[r.doc_id, stems.stem(w)] = want.get((r.doc_id, stems.stem(w)), 0) + 1
    assert {(r.id, r.term): r.tf for r in catalogue.QUERIES["stemmed_terms"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["page_text", "page_metadata"])
def test_pages_against_plain_functions(spark, name):
    held = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalogue.QUERIES[name](spark, SF).collect():
        p = held[r.page_id]
        if name == "page_text":
            assert r.text == pages.html_text(p.html or "")
            assert "<" not in r.text or "&lt;" in p.html
        else:
            assert {k: v for k, v in r.asDict().items() if k != "page_id" and v is not None} == {k: v for k, v in pages.page_card(p.html or "", p.url or "").items() if v is not None}


def test_every_query_without_sql_is_tested():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {*REPLAYS, "text_widths", "token_estimates", "truncated_texts", "trimmed_items", "stemmed_terms", "page_text", "page_metadata"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
