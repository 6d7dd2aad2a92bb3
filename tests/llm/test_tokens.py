"""Encoding, decoding and shard files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import bpe, fragments, queries, runtime, wavelet

ODD = ["", "a\n\n\nb", "  x", "don't  we'll '' 's", "<|endoftext|>  b<|endoftext|>", "é  b  　c", "'!s'!s..'re", "\x85\x85a", "x\x1c\x1cy", "İSTANBUL ΣΑΣ", "é ́a,́", "<|ENDOFTEXT|> <|startoftext|>a", "\U0001f600\U0001f600 ok", "ab" * 3000]
PIECES = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "!", ".", "|", "<|endoftext|>", "é", "\xa0", "　", "1", "Σ", "́", "漢", "\U0001f600", "\x85", "\x1c", "ing"]
BYTE = queries._path("byte_bpe_50k.json")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_fragments_give_the_library_s_ids(name, kind):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    own, library = fragments.FragmentEncoder(queries._path(name), kind, memo=500), Tokenizer.from_file(queries._path(name))
    for part in (texts[:1000], texts[1000:]):
        ids, before = own.encode(*runtime.text_bytes(pa.array(part)))
        for i, text in enumerate(part):
            assert ids[before[i] : before[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark):
    texts = [*ODD, None, "same", "same"]
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), BYTE).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), BYTE).count() == 0
    encoded = bpe.encode_ids(documents(spark, texts), BYTE)
    assert {r.doc_id: r.text for r in bpe.decode_ids(encoded, BYTE).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_shard_lookups():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(90_000) < 0.7, rng.integers(0, 5, 90_000), rng.integers(0, 50_000, 90_000)).astype(np.uint16)
    shard = wavelet.WaveletShard(wavelet.build(ids, [5, None], np.array([40_000, 50_000])))
    assert (shard.decode() == ids).all() and shard.doc_ids == [5, None]
    for token in (0, 3, int(ids[-1]), 65_000):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.rank(token, 44_444) == int((places < 44_444).sum())
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert shard.select(token, k) == places[k]
    for i in (0, 32_767, 32_768, 89_999):
        assert shard.access(i) == ids[i]
    one = wavelet.WaveletShard(wavelet.build(np.array([7, 7], np.uint16), [1], np.array([2])))
    assert one.decode().tolist() == [7, 7] and one.select(7, 1) == 1


def test_token_files(spark):
    texts = [*ODD, None, "same", "same"]
    library = Tokenizer.from_file(BYTE)
    manifest = wavelet.token_files(documents(spark, texts), BYTE, end_id=2, shard_tokens=50)
    got = {r.doc_id: r for r in wavelet.digest_shards(manifest).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.digest_shards(wavelet.token_files(documents(spark, []), BYTE)).count() == 0


def test_very_long_texts(spark):
    """Texts far larger than a chunk, with and without cuts, are encoded whole and fill shards of their own."""
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["alpha", "beta", "it's", "12,5", "é", "\n"]) for _ in range(900_000))
    texts = ["short", long, "x" * 60_000, "end"]
    library = Tokenizer.from_file(BYTE)
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got = {r.doc_id: r for r in wavelet.digest_shards(wavelet.token_files(documents(spark, texts), BYTE, end_id=2)).collect()}
    start = 0
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    trip = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), BYTE).collect()}
    assert all(trip[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and trip[i].n_tokens == len(want[i]) - 1 for i, t in enumerate(texts))
