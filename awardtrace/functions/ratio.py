"""The one comparison Spark has no expression for: the Ratcliff-Obershelp ratio.

All pairs of a batch are compared together in numpy: their open blocks form one list,
each round finds the longest common run of every block row by row, and what lies left
and right of it is the next list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of the comparison tables of one round.
_CELLS = 2_000_000
#: Fixed value: from this length of the second text on, characters above 1 % of it, plus one, begin no run.
_FREQUENT_FROM = 200


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)


def _frequent(b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Characters of long second texts that are too frequent to begin a run."""
    out = np.zeros(b.shape, dtype=bool)
    for p in np.flatnonzero(lengths >= _FREQUENT_FROM):
        n = int(lengths[p])
        chars, where, counts = np.unique(b[p, :n], return_inverse=True, return_counts=True)
        out[p, :n] = (counts > n // 100 + 1)[where]
    return out


def _longest(a, b, skip, p, alo, ahi, blo, bhi):
    """Start in both texts and length of the longest common run of each block; the earliest in a, then in b."""
    height, width = int((ahi - alo).max()), int((bhi - blo).max())
    columns = blo[:, None] + np.arange(width)
    open_ = columns < bhi[:, None]
    columns = np.minimum(columns, b.shape[1] - 1)
    window = b[p[:, None], columns]
    open_ &= ~skip[p[:, None], columns]
    run = np.zeros((len(p), width + 1), dtype=np.int32)
    size, at_a, at_b = np.zeros(len(p), dtype=np.int64), alo.copy(), blo.copy()
    for step in range(height):
        i = alo + step
        char = a[p, np.minimum(i, a.shape[1] - 1)]
        same = open_ & (window == char[:, None]) & (i < ahi)[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        end = run.argmax(1)
        length = run[np.arange(len(p)), end]
        better = length > size
        size = np.where(better, length, size)
        at_a = np.where(better, i - length + 1, at_a)
        at_b = np.where(better, blo + end - length, at_b)
    # Frequent characters do not begin a run, but they continue one.
    for step, side in ((-1, "left"), (1, "right")):
        while True:
            i = at_a - 1 if side == "left" else at_a + size
            j = at_b - 1 if side == "left" else at_b + size
            inside = (i >= alo) & (j >= blo) & (i < ahi) & (j < bhi)
            grows = inside & (a[p, np.clip(i, 0, a.shape[1] - 1)] == b[p, np.clip(j, 0, b.shape[1] - 1)])
            grows &= (size > 0) | (side == "right")
            if not grows.any():
                break
            size = size + grows
            if side == "left":
                at_a, at_b = at_a - grows, at_b - grows
    return at_a, at_b, size


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the characters in common runs over all characters; 0 where a text is empty. The order counts."""
    result = np.zeros(len(left))
    sizes_a = np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    sizes_b = np.fromiter(map(len, right), dtype=np.int64, count=len(right))
    order = np.flatnonzero((sizes_a > 0) & (sizes_b > 0))
    order = order[np.argsort(sizes_b[order], kind="stable")]  # texts of like length together
    first = 0
    while first < len(order):
        width = max(int(sizes_b[order[first]]) * 2, 16)
        last = min(first + max(1, _CELLS // width), int(np.searchsorted(sizes_b[order], width, side="right")))
        last = max(last, first + 1)
        rows = order[first:last]
        first = last
        na, nb = sizes_a[rows], sizes_b[rows]
        a = _codes([left[r] for r in rows], int(na.max()))
        b = _codes([right[r] for r in rows], int(nb.max()))
        skip, total = _frequent(b, nb), np.zeros(len(rows), dtype=np.int64)
        p, alo, ahi, blo, bhi = np.arange(len(rows)), np.zeros_like(na), na, np.zeros_like(nb), nb
        while len(p):
            at_a, at_b, size = _longest(a, b, skip, p, alo, ahi, blo, bhi)
            np.add.at(total, p, size)
            found = size > 0
            p, alo, ahi, blo, bhi, at_a, at_b, size = (
                x[found] for x in (p, alo, ahi, blo, bhi, at_a, at_b, size))
            p = np.r_[p, p]
            alo, ahi = np.r_[alo, at_a + size], np.r_[at_a, ahi]
            blo, bhi = np.r_[blo, at_b + size], np.r_[at_b, bhi]
            open_ = (alo < ahi) & (blo < bhi)
            p, alo, ahi, blo, bhi = (x[open_] for x in (p, alo, ahi, blo, bhi))
        result[rows] = 2.0 * total / (na + nb)
    return result


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two texts; it depends on their order. Null where either is null, at hardly any cost."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    pairs = pd.DataFrame({"a": a[known], "b": b[known]})
    distinct = pairs.drop_duplicates()
    if len(distinct):
        values = distinct.assign(r=ratios(distinct["a"].tolist(), distinct["b"].tolist()))
        out[known] = pairs.merge(values, on=["a", "b"], how="left")["r"].to_numpy()
    return pd.Series(out)  # not a number stands for null
