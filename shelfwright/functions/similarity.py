"""Similarities of strings in percent, as vectorised functions.

`ratio` is 200·LCS/(len a + len b). The longest common subsequence runs over the bits of one integer per row (bit-parallel), which
takes a few microseconds for titles of any usual length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u) | (v - u)
    return (~v & full).bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    s1, s2 = (" ".join(filter(None, (both, " ".join(sorted(own))))) for own in (x - y, y - x))
    return max(ratio_of(s1, s2), *((ratio_of(both, s1), ratio_of(both, s2)) if both else (0.0,)))


def partial_of(a: str, b: str) -> float:
    """Best alignment of the shorter string with a stretch of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if part and (part[0] in short or part[-1] in short):
            best = max(best, ratio_of(short, part))
    return best


def _vectorised(f, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def ratio(a: Column, b: Column) -> Column:
    return _vectorised(ratio_of, a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _vectorised(token_sort_of, a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _vectorised(token_set_of, a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _vectorised(partial_of, a, b)


def tokens(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(col, r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def near_match(a: Column, b: Column) -> Column:
    """Whether two compared folder names are the same but for stop words or little else."""
    x, y = tokens(a), tokens(b)
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    stop = F.array(*map(F.lit, D.STOP_WORDS))
    subset = (F.size(F.array_except(small, large)) == 0) & (F.size(small) >= 2) & (F.size(F.array_except(F.array_except(large, small), stop)) == 0)
    return F.when(a == b, True).when((F.size(x) < 2) & (F.size(y) < 2), False).when(subset, True).otherwise(jaccard(a, b) >= D.NEAR)
