"""Edit distance and ratio of strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by code points."""
    return F.levenshtein(a, b)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine word a character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """200 * common subsequence / summed lengths; two empty strings are alike."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")
