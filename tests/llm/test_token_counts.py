"""Edited counts against encoding the edited text anew."""

import random

from tokenizers import Tokenizer

from palimpsest.llm import fragments, queries, token_counts

PATH = queries._path("byte_bpe_50k.json")
WORDS = ["the", " ", "  ", "\n", "it's", "don't", "<|endoftext|>", "é", "漢字", "\xa0", "　", "42", "!?", "'", "longer-word", "\t"]


def test_trees_follow_edits():
    rnd = random.Random(5)
    library, source = Tokenizer.from_file(PATH), fragments.FragmentEncoder(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for n in [0, 1, 5, 400, 4000]:
        text = "".join(rnd.choice(WORDS) + rnd.choice(["", " "]) for _ in range(n))
        tree = token_counts.TokenTree.of(text, source)
        assert (tree.n_tokens, tree.n_chars, tree.text()) == (count(text), len(text), text)
        for _ in range(60):
            a = rnd.randrange(-2, len(text) + 3)
            b = a + rnd.choice([0, 0, 1, 3, 30, 2000 if rnd.random() < 0.1 else 5])
            new = "".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 2, 8, 900 if rnd.random() < 0.1 else 3])))
            tree.edit(a, b, new)
            x = min(max(a, 0), len(text))
            text = text[:x] + new + text[min(max(b, x), len(text)) :]
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == count(text), (a, b, new)
        again = token_counts.TokenTree.from_bytes(tree.to_bytes(), source)
        assert again.n_tokens == tree.n_tokens and again.text() == text
    big = token_counts.TokenTree.of("plain words here. " * 20_000, source)
    big.edit(180_000, 180_003, "new")
    assert big.encoded < 3 * token_counts.LEAF


def test_query_operators(spark):
    rows = [(1, "some words here " * 100, [(0, 0, "x "), (50, 60, None)]), (None, None, [(5, 1, "abc")]), (3, "", None), (3, "kept", [None, (None, 2, "no")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start:bigint,end:bigint,replacement:string>>").withColumn("tree_", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    first = "x " + "some words here " * 100
    want = [(None, 0, 1, count("abc")), (1, count(rows[0][1]), 2, count(first[:50] + first[60:])), (3, 0, 0, 0), (3, count("kept"), 0, count("kept"))]
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in token_counts.edited_counts(df, PATH).collect()), key=key)
    assert got == sorted(want, key=key)
    trees = token_counts.build_trees(df.filter("doc_id = 1"), PATH).join(df.select("doc_id", "edits"), "doc_id")
    (row,) = token_counts.edit_trees(trees, PATH).collect()
    assert (row.n_tokens, row.n_tokens_after) == want[1][1::2]
    assert token_counts.edited_counts(df.limit(0), PATH).count() == 0
