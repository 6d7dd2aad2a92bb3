"""Token counts that survive edits.

A document is kept as a tree over leaves. A leaf is a run of pre-tokens with its text and token count; leaves meet only
where a character that is not white space stands before ASCII white space, a place that is a pre-token boundary whatever
stands around it. Inner nodes hold the sums of characters and tokens below them. An edit replaces characters start..end:
the tree leads to the leaves it touches, a neighbour is added where the edit reaches a leaf's edge (boundary context), only
their text is encoded again, and sums change on the paths from these leaves to the root alone. Only where an edit brings
so much text that its leaves would grow too large are there more leaves: the sums are then added up anew, over old counts.

Contract for odd input: a null text counts as empty; edits are clipped to the text as it is when they come; an edit whose
start lies after its end is an insertion at start; a null replacement is empty, and an edit without place is skipped; null
and repeated doc_ids are kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.fragments import FragmentEncoder, encoder
from palimpsest.llm.runtime import ENCODER_BYTES, bounded, chunks, text_bytes
from palimpsest.llm.textops import SPACE

#: Bytes of text that a leaf is made with at least; leaves end at the next safe place.
LEAF = 512
#: Children of an inner node.
FAN = 16


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Offsets where text may be split into leaves: after a byte of ASCII print or a letter, before ASCII white space.

    The left byte must be printable ASCII: the last byte of other characters may end white space.
    """
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    left, right = raw[:-1], raw[1:]
    return np.flatnonzero((left > 32) & (left < 127) & SPACE[right]) + 1


def _cuts(raw: np.ndarray, size: int = LEAF) -> list[int]:
    """Ends of leaves of about ``size`` bytes."""
    places = safe_places(raw)
    out, at = [], 0
    while True:
        k = int(np.searchsorted(places, at + size))
        if k >= len(places) or len(raw) - at <= size:
            break
        at = int(places[k])
        out.append(at)
    return [*out, len(raw)]


class TokenTree:
    """One document's tree. ``texts`` are the leaves' texts; level 0 of ``chars`` and ``tokens`` belongs to the leaves."""

    def __init__(self, texts: list[str], tokens: list[int], source: FragmentEncoder):
        self.texts, self.source = texts or [""], source
        self.encoded = 0
        self._sum([len(t) for t in self.texts], tokens or [0])

    @classmethod
    def of(cls, text: str, source: FragmentEncoder) -> TokenTree:
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.array([0, *_cuts(raw)])
        return cls(*_leaves(raw, ends, source), source)

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = [chars], [tokens]
        while len(self.chars[-1]) > 1:
            for levels in (self.chars, self.tokens):
                below = levels[-1]
                levels.append([sum(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def n_tokens(self) -> int:
        return self.tokens[-1][0]

    @property
    def n_chars(self) -> int:
        return self.chars[-1][0]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf that holds character ``at``, its first character); the end of the text belongs to the last leaf."""
        node, first = 0, 0
        for level in range(len(self.chars) - 2, -1, -1):
            node *= FAN
            row = self.chars[level]
            last = min(node + FAN, len(row)) - 1
            while node < last and first + row[node] <= at:
                first += row[node]
                node += 1
        return node, first

    def region(self, start: int, end: int, replacement: str) -> tuple[int, int, np.ndarray, list[int]]:
        """(first leaf, last leaf, new bytes of the leaves that an edit touches, ends of the leaves to make of them)."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        a, first = self._leaf(start)
        b, last = self._leaf(max(start, end - 1))
        stop = last + self.chars[0][b]
        while a > 0 and start <= first:  # the edit reaches the leaf's left edge
            a -= 1
            first -= self.chars[0][a]
        while b < len(self.texts) - 1 and end >= stop:
            b += 1
            stop += self.chars[0][b]
        old = "".join(self.texts[a : b + 1])
        new = old[: start - first] + replacement + old[end - first :]
        self.encoded += len(new)
        raw = np.frombuffer(new.encode(), np.uint8)
        slots = b + 1 - a
        size = LEAF if len(raw) > 4 * LEAF * slots else max(LEAF, -(-len(raw) // slots))
        return a, b, raw, [0, *_cuts(raw, size)]

    def put(self, a: int, b: int, texts: list[str], tokens: list[int]) -> None:
        """Let leaves a..b hold these texts, and bring the sums above them up to date."""
        slots = b + 1 - a
        if len(texts) > slots:  # the leaves would grow too large: more leaves, so a new tree over the old counts
            self.texts[a : b + 1] = texts
            chars = self.chars[0][:a] + [len(t) for t in texts] + self.chars[0][b + 1 :]
            self._sum(chars, self.tokens[0][:a] + tokens + self.tokens[0][b + 1 :])
            return
        for k in range(slots):  # a slot without text stays, with sums of 0
            self.texts[a + k] = texts[k] if k < len(texts) else ""
            self.chars[0][a + k] = len(self.texts[a + k])
            self.tokens[0][a + k] = tokens[k] if k < len(texts) else 0
        lo, hi = a, b
        for level in range(1, len(self.chars)):
            lo, hi = lo // FAN, hi // FAN
            for levels in (self.chars, self.tokens):
                for node in range(lo, hi + 1):
                    levels[level][node] = sum(levels[level - 1][node * FAN : node * FAN + FAN])

    def edit(self, start: int, end: int, replacement: str) -> None:
        a, b, raw, ends = self.region(start, end, replacement)
        self.put(a, b, *_leaves(raw, np.array(ends), self.source))

    def to_bytes(self) -> bytes:
        return json.dumps({"texts": self.texts, "tokens": self.tokens[0]}).encode()

    @classmethod
    def from_bytes(cls, data: bytes, source: FragmentEncoder) -> TokenTree:
        held = json.loads(data)
        return cls(held["texts"], held["tokens"], source)


def _leaves(raw: np.ndarray, ends: np.ndarray, source: FragmentEncoder) -> tuple[list[str], list[int]]:
    _, before = source.encode(raw, ends)
    return [raw[x:y].tobytes().decode() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.diff(before).tolist()


def _grown(batch: pa.RecordBatch, column: int, source: FragmentEncoder) -> list[TokenTree]:
    """The trees of all texts of a batch; all their leaves are encoded in one call."""
    raw, offsets = text_bytes(batch.column(column))
    ends, counts = [0], []
    for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cuts = _cuts(raw[x:y])
        ends += [x + c for c in cuts]
        counts.append(len(cuts))
    texts, tokens = _leaves(raw, np.array(ends), source)
    out, at = [], 0
    for n in counts:
        out.append(TokenTree(texts[at : at + n], tokens[at : at + n], source))
        at += n
    return out


def _apply(trees: list[TokenTree], edits: list[list[dict] | None], source: FragmentEncoder) -> list[int]:
    """Apply each tree's edits in order; the regions of all trees' k-th edits are encoded in one call. Returns edits done."""
    todo = [[e for e in own or [] if e is not None and e["start"] is not None] for own in edits]
    for k in range(max(map(len, todo), default=0)):
        asked = [(tree, tree.region(e["start"], e["start"] if e["end"] is None else e["end"], e["replacement"] or "")) for tree, own in zip(trees, todo, strict=True) if len(own) > k for e in [own[k]]]
        ends, at = [0], 0
        for _, (_, _, raw, cuts) in asked:
            ends += [at + c for c in cuts[1:]]
            at += len(raw)
        texts, tokens = _leaves(np.concatenate([r[2] for _, r in asked]), np.array(ends), source)
        at = 0
        for tree, (a, b, _, cuts) in asked:
            n = len(cuts) - 1
            tree.put(a, b, texts[at : at + n], tokens[at : at + n])
            at += n
    return [len(own) for own in todo]


_OUT = "n_tokens bigint, n_edits int, n_chars_after bigint, n_tokens_after bigint, n_chars_encoded bigint"
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"


def build_trees(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, tree (bytes to keep for later edits) of each text."""

    def run(batches):
        source = encoder(path, "byte")
        for batch in chunks(batches, "text", ENCODER_BYTES):
            trees = _grown(batch, 1, source)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary())], names=["doc_id", "n_tokens", "tree"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, tree binary")


def edit_trees(trees: DataFrame, path: str) -> DataFrame:
    """Apply column ``edits`` to kept trees: doc_id, counts before and after, and the new tree."""

    def run(batches):
        source = encoder(path, "byte")
        for batch in chunks(batches, "tree"):
            trees = [TokenTree.from_bytes(data, source) if data is not None else TokenTree.of("", source) for data in batch.column(1).to_pylist()]
            before = [t.n_tokens for t in trees]
            done = _apply(trees, batch.column(2).to_pylist(), source)
            rows = [(n, k, t.n_chars, t.n_tokens, t.encoded, t.to_bytes()) for n, k, t in zip(before, done, trees, strict=True)]
            yield _batch(batch.column(0), rows, True)

    return trees.select("doc_id", "tree", F.col("edits").cast(EDITS)).mapInArrow(run, f"doc_id bigint, {_OUT}, tree binary")


def edited_counts(df: DataFrame, path: str) -> DataFrame:
    """Grow each text's tree, apply its ``edits`` in order, and return the counts; trees never leave the task."""

    def run(batches):
        source = encoder(path, "byte")
        for batch in chunks(batches, "text", ENCODER_BYTES):
            trees = _grown(batch, 1, source)
            before = [t.n_tokens for t in trees]
            done = _apply(trees, batch.column(2).to_pylist(), source)
            rows = [(n, k, t.n_chars, t.n_tokens, t.encoded) for n, k, t in zip(before, done, trees, strict=True)]
            yield _batch(batch.column(0), rows, False)

    return bounded(df).select("doc_id", "text", F.col("edits").cast(EDITS)).mapInArrow(run, f"doc_id bigint, {_OUT}")


def _batch(ids: pa.Array, rows: list[tuple], with_tree: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_tree else [])]
    names = ["n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_encoded", *(["tree"] if with_tree else [])]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])
