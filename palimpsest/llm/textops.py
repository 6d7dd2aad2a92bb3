"""Vectorised words, shingles and hashes over the bytes of many texts at once.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; upper-case A-Z count as lower case.
Empty texts have no words; no function sees a null (``runtime.text_bytes`` makes it empty).
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII letters and every byte of a non-ASCII character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    while len(_powers["up"]) <= n:
        for key, base in (("up", int(_MULTIPLIER)), ("down", int(_INVERSE))):
            have = _powers[key]
            _powers[key] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that makes every output bit depend on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs of bytes in class ``inside``; no run spans two texts."""
    n = len(raw)
    kept = inside[raw]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    last = kept.copy()
    last[:-1] &= ~kept[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    first[borders] |= kept[borders]
    last[borders - 1] |= kept[borders - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], upper-case A-Z folded: a random value per byte times a power of its place."""
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text)."""
    starts, ends, before = runs(raw, offsets, ~SPACE)
    return run_hashes(raw, starts, ends), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than ``size`` words has one shingle, its whole sequence; a text without words has none.
    """
    n = len(words)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(total)]
    total = mix(total)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            x = 0
            for w in words[a:b].tolist():
                x = (x * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([x ^ (0xA5A5A5A5 + b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
