"""Encoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up inside one token, so the text may be
cut there. Fragments between cuts repeat a lot: each distinct fragment is encoded once by the tokenizers library, kept
in a memo bounded by count and by bytes, and the ids of a text are those of its fragments in a row. A full memo keeps the
half that was used last.

For the cut to be certain the pre-tokenizer must also give the same pieces on both sides. A pair is therefore refused
 * if its left byte may end white space (the rule for trailing white space looks ahead),
 * if its right byte is an apostrophe (a contraction must see what stands before it),
 * if it lies inside an added token's own text or inside a character.

A null text counts as empty and has no ids; a text without a cut is one fragment, whatever its length.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that is not ASCII: their last bytes also end ordinary characters, so these are looked up as text.
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_ASCII_SPACE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FragmentEncoder:
    """Encodes texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` does, fragment by fragment.

    ``kind`` 'byte' takes cuts from byte pairs found in no token of a byte-level vocabulary. ``kind`` 'word' serves
    vocabularies whose pre-tokenizer drops white space: it cuts around ASCII white space, which no token holds, and
    between an ASCII letter and ASCII punctuation.
    """

    def __init__(self, path: str, kind: str = "byte", memo: int = 500_000, memo_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.limit, self.most = kind, memo, memo_bytes
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = self._byte_table() if kind == "byte" else self._word_table()
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held = self.calls = 0
        self.starts, self.counts, self.seen = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32), 0

    def _byte_table(self) -> np.ndarray:
        table = np.ones((256, 256), bool)
        stand_in = byte_alphabet()
        added = set(self.added)
        for token in self.tokenizer.get_vocab(with_added_tokens=True):
            raw = token.encode() if token in added else bytes(stand_in[c] for c in token)
            for a, b in zip(raw, raw[1:]):
                table[a, b] = False
        for literal in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"):
            for a, b in zip(literal, literal[1:]):
                table[a, b] = False
        table[list(_ASCII_SPACE), :] = False
        table[:, ord("'")] = False
        table[:, 0x80:0xC0] = False
        return table

    def _word_table(self) -> np.ndarray:
        table = np.zeros((256, 256), bool)
        space = [9, 10, 11, 12, 13, 32]
        letters = [*range(65, 91), *range(97, 123)]
        marks = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]
        table[np.ix_(letters, marks)] = True
        for content in self.added:
            raw = content.encode()
            for a, b in zip(raw, raw[1:]):
                table[a, b] = False
        table[space, :] = table[:, space] = True
        table[:, 0x80:0xC0] = False
        return table

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(fragments, fragments before each text)."""
        n = len(raw)
        cuts = np.zeros(n + 1, bool)
        if n > 1:
            cuts[1:n] = self.cut.ravel()[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
            if self.kind == "byte" and not _ascii(raw):
                self._spare_wide_space(raw, cuts)
        cuts[offsets] = True
        at = np.flatnonzero(cuts[: n + 1])
        if len(at) == 0 or at[0] != 0:
            at = np.concatenate([[0], at])
        if at[-1] != n:
            at = np.concatenate([at, [n]])
        array = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        return array, np.searchsorted(at, offsets)

    @staticmethod
    def _spare_wide_space(raw: np.ndarray, cuts: np.ndarray) -> None:
        """No cut just after white space outside ASCII."""
        text = raw.tobytes().decode()
        if _WIDE_SPACE.search(text):
            at = 0
            seen = 0
            for m in _WIDE_SPACE.finditer(text):
                at += len(text[seen : m.end()].encode())
                seen = m.end()
                cuts[at] = False

    def _learn(self, new: list[bytes]) -> None:
        """Encode fragments unknown so far, many in a call: each is a pretokenized word of its own."""
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            texts = [x.decode() for x in part]
            whole = "\x00".join(texts)
            special = any(a in whole for a in self.added)
            encoding = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, self.pool.dtype)
            words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
            pieces = None
            if special or (words < 0).any():  # added tokens belong to no word; such fragments go one by one
                pieces = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.pool.dtype) for t in texts]
                ids = np.concatenate(pieces) if pieces else ids
                counts = np.array([len(p) for p in pieces], np.int64)
            else:
                counts = np.bincount(words, minlength=len(part)).astype(np.int64)
            self._store(part, ids, counts)

    def _store(self, part: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        k = len(self.memo)
        while k + len(part) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.starts[k : k + len(part)] = self.used + np.cumsum(counts) - counts
        self.counts[k : k + len(part)] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.memo.update(zip(part, range(k, k + len(part)), strict=True))
        self.held += sum(map(len, part))

    def _keep_recent(self) -> None:
        """Forget all but the fragments used last: half of the limits at most."""
        keys = list(self.memo)  # in the order of their places
        recent = np.argsort(-self.seen[: len(keys)], kind="stable")[: self.limit // 2]
        sizes = np.cumsum(np.fromiter((len(keys[i]) for i in recent.tolist()), np.int64, len(recent)))
        kept = np.sort(recent[: int(np.searchsorted(sizes, self.most // 2, "right"))])
        starts, counts, seen, calls = self.starts[kept], self.counts[kept], self.seen[kept], self.calls
        take = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        ids = self.pool[take]
        self._clear()
        self._store([keys[i] for i in kept.tolist()], ids, counts)
        self.seen[: len(kept)], self.calls = seen, calls

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids before each text) for texts given as UTF-8 bytes and offsets."""
        array, before = self.fragments(raw, offsets)
        if len(array) == 0:
            return np.zeros(0, self.pool.dtype), np.zeros(len(offsets), np.int64)
        coded = pc.dictionary_encode(array)
        distinct = coded.dictionary.to_pylist()
        if self.held > self.most or len(self.memo) > self.limit:
            self._keep_recent()  # what one call brings is bounded by its chunk of texts
        get = self.memo.get
        known = [get(x, -1) for x in distinct]
        new = [x for x, k in zip(distinct, known, strict=True) if k < 0]
        if new:
            self._learn(new)
            known = [k if k >= 0 else self.memo[x] for x, k in zip(distinct, known, strict=True)]
        places = np.array(known, np.int64)
        self.calls += 1
        self.seen[places] = self.calls
        place = places[np.asarray(coded.indices)]
        counts = self.counts[place]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        take = np.arange(total, dtype=np.int64) + np.repeat(self.starts[place] - (ends - counts), counts)
        return self.pool[take], np.concatenate([[0], ends])[before]


def _ascii(raw: np.ndarray) -> bool:
    return not (raw >= 128).any() and not ((raw >= 28) & (raw < 32)).any()


@functools.cache
def encoder(path: str, kind: str) -> FragmentEncoder:
    """One encoder for each Python worker; its memo lasts from task to task."""
    return FragmentEncoder(path, kind)
