"""Token-set similarity of two strings, 0 to 100, as an Arrow UDF.

Distinct tokens of either side are split into common and own ones; a side without own tokens gives 100, else the best of three
normalised insert-delete distances counts (own against own, common against common plus own). The longest common subsequence runs bit-parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_set(a: str | None, b: str | None) -> float:
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common, mine, theirs = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not mine or not theirs):
        return 100.0
    gap = len(common) + bool(common)
    distance = len(mine) + len(theirs) - 2 * lcs(mine, theirs)
    scores = [100 - 100 * distance / max(2 * gap + len(mine) + len(theirs), 1)]
    if common:
        scores += [100 - 100 * (1 + len(own)) / (2 * len(common) + 1 + len(own)) for own in (mine, theirs)]
    return max(scores)


def token_set_ratio(a, b):
    """token_set of two columns. The UDF is made on the driver, as workers that import this module cannot."""
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {pair: token_set(*pair) for pair in set(zip(a, b, strict=True))}
        return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)
