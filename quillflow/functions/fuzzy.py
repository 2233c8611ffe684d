"""Approximate text comparison that Spark has no function for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all characters."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def token_set(a: str, b: str) -> float:
    """Best likeness (0 to 100) of the shared tokens, and the shared tokens with either side's rest, to one another.

    Likeness: 100 less the share of characters to insert or delete. A side without a rest is wholly shared.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 100.0
    gap = bool(both)
    n, m = len(both) + gap + len(left), len(both) + gap + len(right)
    found = 1 - (len(left) + len(right) - 2 * common(left, right)) / (n + m)
    if both:
        found = max(found, 1 - (1 + len(left)) / (len(both) + n), 1 - (1 + len(right)) / (len(both) + m))
    return 100 * found


def _sequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(ratio(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")


def _tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(token_set(x.upper(), y.upper()), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """`ratio` of two columns; null if either is null."""
    return F.pandas_udf(_sequence, DoubleType())(a, b)


def first_like(words: Column, target: str, least: float) -> Column:
    """The place (from 0) of the first of an array's words whose `ratio` to a text is large enough; null if none is."""

    def place(lists: pd.Series) -> pd.Series:
        return pd.Series([None if ws is None else next((k for k, w in enumerate(ws) if ratio(w, target) >= least), None) for ws in lists], dtype="Int32")

    return F.pandas_udf(place, IntegerType())(words)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """`token_set` of two columns, ignoring case; null if either is null."""
    return F.pandas_udf(_tokens, DoubleType())(a, b)
