"""Sets of n-word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from awardtrace.llm.signature_tree import width_for

#: Texts are worked on together up to so many bytes (one text is never cut) and rows; a row's number takes 16 bits.
BLOCK_BYTES, BLOCK_ROWS = 100_000, 20_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
_INSIDE = ~np.isin(_BYTES, np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the first k bytes of eight


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Sets:
    """The sets of some texts: sorted distinct hashes, those of text k from ``ends[k]`` to ``ends[k + 1]``."""

    tokens: np.ndarray
    ends: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.tokens[a:b] for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist()))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    @property
    def rows(self) -> np.ndarray:
        """The text that each shingle is of."""
        return np.repeat(np.arange(len(self.ends) - 1), self.sizes)

    def bitmaps(self) -> pa.Array:
        """Each set's ``bitmap`` in its own width; an empty set has none."""
        sizes = self.sizes
        widths = np.array([width_for(n) if n else 0 for n in sizes.tolist()], dtype=np.int64)
        starts = np.r_[0, np.cumsum(widths)]
        bits = np.zeros(starts[-1], dtype=np.uint8)
        place = (self.tokens & np.repeat((widths - 1).clip(0).astype(np.uint64), sizes)).astype(np.int64)
        bits[np.repeat(starts[:-1], sizes) + place] = 1
        data = np.packbits(bits, bitorder="little")
        ends = pa.py_buffer(starts // 8)
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, ends, pa.py_buffer(data)]).cast(pa.binary())


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, some at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        last = min(last, first + BLOCK_ROWS)
        yield texts[first:last]
        first = last


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else _BYTES[:0]
    ends = ends - ends[0]
    inside = _INSIDE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)  # where a text begins
    fresh[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    stops[:-1] &= ~inside[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    counts = np.diff(np.searchsorted(starts, ends))

    folded = np.concatenate([_LOWER[data], np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(data) + 1, dtype=np.uint64, buffer=folded, strides=(1,))
    hashes = lengths.astype(np.uint64)
    at = np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(at):
        left = lengths[at] - done
        lane = eights[starts[at] + done] & _FIRST[np.minimum(left, 8)]
        hashes[at] = _spread(hashes[at] * _M1 + lane)
        at, done = at[left > 8], done + 8
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(folded[starts[k]:starts[k] + lengths[k]])
    return hashes, counts


def in_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys below 65,536: numpy sorts numbers of 16 bits in linear time."""
    return np.argsort(keys.astype(np.uint16), kind="stable")


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    """The sets of n-word shingles of a block; of a shorter text, all its words are its one shingle. A to Z are folded."""
    hashes, counts = _words(texts)
    starts = np.cumsum(counts) - counts
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(rows: np.ndarray, at: np.ndarray, length: int) -> None:
        """The shingles of so many words that begin at these."""
        rolled = np.full(len(at), length, dtype=np.uint64)
        for k in range(length):
            rolled = _spread(rolled * _M1 + hashes[at + k])
        found.append((rows, rolled))

    short = np.flatnonzero((counts > 0) & (counts < n))
    for length in np.unique(counts[short]).tolist():
        rows = short[counts[short] == length]
        take(rows, starts[rows], length)
    each = np.maximum(counts - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    take(rows, np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + starts[rows], n)
    rows, tokens = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(tokens)
    order = order[in_order(rows[order])]
    rows, tokens = rows[order], tokens[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    sizes = np.bincount(rows[first], minlength=len(counts))
    return Sets(tokens[first], np.r_[0, np.cumsum(sizes)])


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """The set of every text."""
    return [own for block in blocks(pa.array(texts, pa.large_string())) for own in shingle_sets(block, n)]
