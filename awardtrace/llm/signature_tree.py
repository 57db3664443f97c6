"""Signature trees over token sets, in numpy.

A set is a bitmap of hashed tokens and a size. A node of the tree holds the OR of its
children's bitmaps and the range of their sizes. Two trees are walked together; a pair
of nodes is left out if no pair of sets below it can share enough tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FAN = 16, 8


def width_for(size: int, least: int = 64) -> int:
    """Bits of a set's own bitmap: a power of two, at least its size."""
    return max(least, 1 << max(size - 1, 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Bits of the tokens' hashes modulo the width, in 64-bit words."""
    bits = np.zeros(width, dtype=np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray) -> np.ndarray:
    """The same bitmaps at half the width."""
    half = maps.shape[-1] // 2
    return maps[..., :half] | maps[..., half:]


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens that sets of these sizes must share for intersection / union >= num / den."""
    return -((-num * (a + b)) // (num + den))


def most_shared(sizes_a, maps_a, sizes_b, maps_b) -> np.ndarray:
    """Upper bound of the tokens that two sets share: neither can share what hits no bit of the other."""
    own = sizes_a - np.bitwise_count(maps_a & ~maps_b).sum(-1, dtype=np.int64)
    other = sizes_b - np.bitwise_count(maps_b & ~maps_a).sum(-1, dtype=np.int64)
    return np.minimum(own, other)


class Classes:
    """Union-find over positions, with labels that can be compared in bulk."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        own, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(own) < len(other):
            a, own, other = b, other, own
        self.label[other] = a
        self.members[a] = own + other


def _levels(sizes: np.ndarray, maps: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From the leaves up: least and largest size, OR of bitmaps, most tokens hidden behind a shared bit, first record."""
    hidden = sizes - np.bitwise_count(maps).sum(-1, dtype=np.int64)
    at = np.arange(0, len(sizes), LEAF)
    level = (np.minimum.reduceat(sizes, at), np.maximum.reduceat(sizes, at), np.bitwise_or.reduceat(maps, at, axis=0),
             np.maximum.reduceat(hidden, at))
    levels = [level]
    while len(levels[-1][0]) > 1:
        low, high, bits, hid = levels[-1]
        at = np.arange(0, len(low), FAN)
        levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                       np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(hid, at)))
    return levels


def walk(sizes: np.ndarray, maps: np.ndarray, num: int, den: int, classes: Classes,
         check: Callable[[int, np.ndarray], np.ndarray] | None = None, first: np.ndarray | None = None,
         link: Callable[[int, np.ndarray], None] | None = None) -> None:
    """Join the classes of all positions whose sets link.

    Sets must be in the order of their sizes, with bitmaps of one width. Without
    ``check`` two sets link if their bound lets them; with it, ``check(i, js)`` says
    which do. Pairs within a class are not looked at again, so a group of near copies
    costs about as many checks as it has sets, not as it has pairs. With ``first``
    only pairs of which one set is marked are looked at. With ``link`` every pair is
    looked at, also within a class, and ``link(i, js)`` is told all those that link, once.
    """
    levels = _levels(sizes, maps)

    def uniform(level: int, a: int, b: int) -> bool:
        """Whether all sets below both nodes are in one class already."""
        span = LEAF * FAN ** level
        label = classes.label
        one = label[a * span]
        return bool((label[a * span:(a + 1) * span] == one).all() and (label[b * span:(b + 1) * span] == one).all())

    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if link is None and uniform(level, a, b):
            continue
        if level:
            low, high, bits, hid = levels[level - 1]
            left = np.arange(a * FAN, min((a + 1) * FAN, len(low)))
            right = np.arange(b * FAN, min((b + 1) * FAN, len(low)))
            i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
            keep = i <= j
            i, j = i[keep], j[keep]
            fits = np.minimum(high[i], high[j]) * den >= np.maximum(low[i], low[j]) * num
            i, j = i[fits], j[fits]
            most = np.minimum(np.minimum(high[i], high[j]), np.minimum(hid[i], hid[j])
                              + np.bitwise_count(bits[i] & bits[j]).sum(-1, dtype=np.int64))
            fits = most >= needed(low[i], low[j], num, den)
            stack += [(level - 1, int(x), int(y)) for x, y in zip(i[fits][::-1], j[fits][::-1])]
            continue
        end_a, end_b = min((a + 1) * LEAF, len(sizes)), min((b + 1) * LEAF, len(sizes))
        for i in range(a * LEAF, end_a):
            js = np.arange(max(b * LEAF, i + 1), end_b)
            if link is None:
                js = js[classes.label[js] != classes.label[i]]
            if first is not None and not first[i]:
                js = js[first[js]]
            if not len(js):
                continue
            least = needed(sizes[i], sizes[js], num, den)
            js = js[most_shared(sizes[i], maps[i], sizes[js], maps[js]) >= least]
            if check is not None and len(js):
                js = js[check(i, js)]
            if link is not None and len(js):
                link(i, js)
            for j in js:
                classes.join(i, int(j))
