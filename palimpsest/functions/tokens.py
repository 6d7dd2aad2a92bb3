"""Token counts and truncation behind one interface.

The counter is a parameter. Without a vocabulary file the estimate is a word or a punctuation mark for a token, with
words of more than four characters counting one more for each four; that is a documented stand-in, not a tokenizer.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = re.compile(r"\w+|[^\w\s]")


def estimate(text: str) -> int:
    return sum(max(1, math.ceil(len(p) / 4)) for p in _PIECE.findall(text))


@functools.cache
def counter(path: str | None = None):
    """text -> tokens: the estimate, or a vocabulary of the tokenizers library (special tokens count as text)."""
    if path is None:
        return estimate
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return lambda text: len(loaded.encode(text, add_special_tokens=False).ids)


def count(text: Column, path: str | None = None) -> Column:
    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        own = counter(path)
        return s.map(lambda x: own(x or ""))

    return run(text)


def truncated(text: str, budget: int, head: float = 0.7, suffix: str | None = None) -> str:
    """Keep the first and last pieces of a text over ``budget`` pieces, and say how many went; or the first, and a suffix."""
    places = [m.end() for m in _PIECE.finditer(text)]
    if len(places) <= budget:
        return text
    if suffix is not None:
        return text[: places[budget - 1]].rstrip() + suffix if budget > 0 else suffix
    first = int(head * budget)
    last = budget - first
    start = text[: places[first - 1]] if first else ""
    end = text[places[len(places) - last - 1] :] if last else "..."
    return f"{start}\n[... trimmed {len(places) - budget} tokens ...]\n{end}"


def truncate(text: Column, budget: int, head: float = 0.7, suffix: str | None = None) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: truncated(x, budget, head, suffix), na_action="ignore")

    return run(text)


def truncate_to(text: str, budget: str, head: float = 0.7) -> Column:
    """Column ``text`` truncated to the budget in column ``budget``."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else truncated(x, int(n), head) for x, n in zip(s, b, strict=True)], dtype="object")

    return run(text, budget)
