"""Word similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: letters of two words together from which an index of letters beats substring search
_INDEXED = 200


def matched(a: str, b: str) -> int:
    """Letters in matching blocks: the longest common block, the first of equal ones, then the same on both sides of it."""
    if not a or not b:
        return 0
    size = at = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:
            size, at = size + 1, i
    if not size:
        return 0
    j = b.find(a[at : at + size])
    return size + matched(a[:at], b[:j]) + matched(a[at + size :], b[j + size :])


def block_ratio(a: str, b: str) -> float:
    """Twice the letters in matching blocks over all letters; one definition for words of any length."""
    if len(a) + len(b) > _INDEXED:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio_udf():
    """Arrow UDF (source, target) -> ``block_ratio`` over word pairs."""

    @F.pandas_udf(DoubleType())
    def ratio(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([block_ratio(a, b) for a, b in zip(source, target)], dtype="float64")

    return ratio


def max_edits(source_len: Column, target_len: Column, ratio: float) -> Column:
    """Upper bound on edits of a pair with at least this matching-blocks ratio.

    Matched characters are at most the longest common subsequence, and with L of those
    there are len1 + len2 - 2L insertions and deletions, so
    edits <= (1 - ratio) * (len1 + len2).
    """
    return F.floor((source_len + target_len) * (1.0 - ratio) + 1e-9).cast("int")
