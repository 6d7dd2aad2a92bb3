"""Near-duplicate groups against all pairs, on small tables."""

import random

import numpy as np
import pandas as pd
import pytest

from palimpsest.llm import components, minhash


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words):
    """component_id of each row by all pairs."""
    sets = [sets_of(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append(min(ids, default=None) if sets[i] else d)
    return [(d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, out, strict=True)]


def near(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(0, 14)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
        rows.append(" ".join(w))
    return rows


def test_groups_against_all_pairs(spark):
    odd = [None, "", "   \n", "One", "one ", "two words", "TWO  words", "two Words here", "same text " * 30, "same text " * 30, "a b c d e f g h i j", "é ü \x1c ö"]
    rows = list(enumerate(odd + near(1, 60) + near(2, 25)))
    rows += [(None, rows[20][1]), (None, "lonely null row"), (3, "again a row of id three"), (20, rows[20][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, kept int, fp string")
    for words in (2, 5):
        got = sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, words=words).collect()]))
        assert got == sorted(map(str, brute(rows, words)))
    kept = minhash.representatives(df, words=2)
    assert kept.columns == df.columns and kept.count() == sum(k for *_, k in brute(rows, 2))
    assert minhash.groups(df.limit(0)).count() == 0


def test_several_leaders_and_small_blocks(spark, monkeypatch):
    rows = list(enumerate(near(5, 150)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for leaders, classes, extras in ((1, 1024, 1 << 20), (3, 7, 50)):
        monkeypatch.setattr(minhash, "BLOCK_CLASSES", classes)
        monkeypatch.setattr(minhash, "BLOCK_EXTRAS", extras)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, words=2, leaders=leaders).collect())
        assert got == sorted(brute(rows, 2))


def test_more_keys_than_a_filter_holds(spark, monkeypatch):
    rows = list(enumerate(near(5, 60)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for keys, shard in ((1, 200_000), (1000, 7)):
        monkeypatch.setattr(minhash, "FILTER_KEYS", keys)
        monkeypatch.setattr(minhash, "SHARD_KEYS", shard)
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, words=2).collect()) == sorted(brute(rows, 2))


def test_very_long_texts(spark):
    """Sets longer than a block of hashes come in parts; a long near copy is still found."""
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(90_000)]
    other = [w if i % 40 else "changed" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long))), (4, "short text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, words=2).collect()) == sorted(brute(rows, 2))


def test_clashing_columns_pass_through(spark):
    names = ["_0", "_1", "_2", "_doc", "_tkey", "_own", "tkey", "fp", "ID", "hub"]
    df = spark.createDataFrame([(i, t, *[f"{i}{n}" for n in names]) for i, t in enumerate(near(1, 12))], f"doc_id bigint, text string, {', '.join(f'{n} string' for n in names)}")
    kept = minhash.representatives(df, words=2)
    assert kept.columns == df.columns and all(r[n] == f"{r.doc_id}{n}" for r in kept.collect() for n in names)


def test_links_of_one_common_bucket(spark):
    """Every link between classes in a common bucket counts, however few buckets they share."""
    rows = list(enumerate(near(8, 120)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bands = {r.doc_id: set(r.bands) for r in minhash.signatures(df, 2, 4, 4).collect()}
    sets = {d: sets_of(t, 2) for d, t in rows}
    component = {d: d for d, _ in rows}
    for i in component:
        for j in range(i):
            if bands[i] & bands[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = component[i], component[j]
                component = {d: new if c == old else c for d, c in component.items()}
    want = {d: min(e for e in component if component[e] == c) for d, c in component.items()}
    got = minhash.groups(df, words=2, bands=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("tile", [1 << 19, 100])
def test_block_pairs_lose_no_link(monkeypatch, tile):
    """All pairs of different components that link stay; what leaves can't link by its count of common shingles."""
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = np.random.default_rng(5)
    hub = set(range(60))
    sets = [(hub - set(rng.choice(60, rng.integers(0, 16), False).tolist())) | {int(x) for x in rng.integers(100, 130, rng.integers(0, 16))} for _ in range(90)]
    comp = rng.integers(0, 4, len(sets))
    frame = pd.DataFrame({"hub": -7, "id": range(len(sets)), "n": [len(s) for s in sets], "inter": [len(s & hub) for s in sets], "comp": comp, "extras": [np.array(sorted(s - hub)) for s in sets]})
    outer = frame[frame["comp"] > 0].reset_index(drop=True)
    a, b = minhash.block_pairs(outer, frame, 80)
    got = set(zip(outer["id"].to_numpy()[a].tolist(), b.tolist(), strict=True))
    for i in outer["id"]:
        for j in range(len(sets)):
            o = len(sets[i] & sets[j])
            if comp[i] != comp[j] and 100 * o >= 80 * len(sets[i] | sets[j]):
                assert (i, j) in got
    for i, j in got:
        bound = len((sets[i] & sets[j]) - hub) + min(len(sets[i] & hub), len(sets[j] & hub))
        assert comp[i] != comp[j] and 180 * bound >= 80 * (len(sets[i]) + len(sets[j]))
    assert 0 < len(got) < len(outer) * len(frame)
    none = minhash.block_pairs(outer.head(0), frame, 80)
    assert len(none[0]) == len(none[1]) == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7), (500, 500)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
