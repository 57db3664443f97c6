"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text is cut into units that no piece crosses: a run of characters with at most one
space before it, a lone space, or a line feed. (A run of over 200 characters is more
than one unit.) Over the lattice of a unit's possible
pieces the forward pass sums the weights of all ways to each place; the backward pass
draws a way from the end by those sums. Draws are hashes of the row's key, the unit
and the step, so a row is cut alike in every run. All units of a batch go through
both passes together in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, text_or_empty

MODEL = "piece_bpe_32k.model"
#: A piece of rank r weighs (r + FIRST) ** -POWER: the vocabulary holds ranks of merges instead of probabilities.
POWER, FIRST = 1.0, 10.0
#: Characters of text that go through the passes at once.
BATCH_CHARS = 500_000
#: Bytes of distinct units whose lattices are worked out at once: an edge takes five times more then than afterwards.
LATTICE_BYTES = 30_000

_UNITS = re.compile(r" ?[^ \n]{1,200}|[ \n]")
_FACTOR = np.uint64(0x100000001B3)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FILTER_BITS = 22


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """Bytes of every piece by id, log weights, the ids of single bytes, and hashes to look pieces up by length.

    ``prefixes`` marks the slots of all beginnings of pieces: most places of a text are
    done with after a few bytes.
    """

    pieces: list[bytes]
    weights: np.ndarray
    of_byte: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    prefixes: np.ndarray


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX1) >> np.uint64(64 - _FILTER_BITS)


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_FACTOR) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece model with byte fallback. Control and unused pieces are never drawn."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces, weights, of_byte = [b""] * size, np.full(size, -np.inf), np.full(256, -1)
    lookup: dict[int, list[tuple[int, int]]] = {}
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            of_byte[int(name[3:5], 16)] = i
            pieces[i] = bytes([int(name[3:5], 16)])
            weights[i] = -POWER * np.log(size + FIRST)
            continue
        pieces[i] = name.replace("▁", " ").encode()
        if model.get_score(i) > -1e8:  # the vocabulary marks runs of spaces as out of use
            weights[i] = -POWER * np.log(FIRST - model.get_score(i))
            lookup.setdefault(len(pieces[i]), []).append((_hash(pieces[i]), i))
    if (of_byte < 0).any():
        raise ValueError("the model has no byte fallback, so decoding could lose text")
    prefixes = np.zeros(1 << _FILTER_BITS, dtype=bool)
    by_length = {}
    for length, found in sorted(lookup.items()):
        found.sort()
        hashes = np.array([h for h, _ in found], dtype=np.uint64)
        by_length[length] = (hashes, np.array([i for _, i in found], dtype=np.int32))
    begun = {pieces[i][:k] for found in lookup.values() for _, i in found for k in range(1, len(pieces[i]) + 1)}
    prefixes[_slot(np.array([_hash(b) for b in begun], dtype=np.uint64))] = True
    return Vocabulary(pieces, weights, of_byte, by_length, prefixes)


def _lattice(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """The lattices of all units, block by block, as the states of one list (``_lattices``)."""
    block = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units))) // LATTICE_BYTES
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    parts, state = [], 0
    for a, b in zip(edges[:-1], edges[1:]):
        parts.append(_lattices(units[a:b], v, state))
        state = int(parts[-1][-1][-1]) + 1
    return tuple(map(np.concatenate, zip(*parts)))


def _lattices(units: list[bytes], v: Vocabulary, state0: int) -> tuple[np.ndarray, ...]:
    """Of some units, with states numbered from ``state0``: per edge, in order of the state it ends in, where it comes from, its piece, and the
    running probability of the edges into that state on top of the state's number; and each unit's last state.

    States are the places between bytes; a unit of n bytes has n + 1, and they follow one another.
    """
    sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    text = np.frombuffer(b"".join(units), dtype=np.uint8)
    unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    ends = np.cumsum(sizes).astype(np.int32)[unit]  # where the byte's unit ends
    state = np.arange(len(text), dtype=np.int32) + unit  # the state before the byte
    sources, targets, ids = [], [], []
    whole = np.zeros(len(text), dtype=np.int8)  # length of the character's own piece
    alive, rolled = np.arange(len(text), dtype=np.int32), np.zeros(len(text), dtype=np.uint64)
    for length in range(1, max(v.by_length) + 1):
        inside = alive + length <= ends[alive]
        alive, rolled = alive[inside], rolled[inside]
        if not len(alive):
            break
        rolled = rolled * _FACTOR + text[alive + (length - 1)] + np.uint64(1)
        begun = v.prefixes[_slot(rolled)]
        alive, rolled = alive[begun], rolled[begun]
        if length not in v.by_length:
            continue
        hashes, own = v.by_length[length]
        place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
        hit = hashes[place] == rolled
        at, place = alive[hit], place[hit]
        sources.append(state[at])
        targets.append(state[at] + length)
        ids.append(own[place])
        whole[at[length == _char_size(text[at])]] = length
    # Bytes of characters that are no piece of their own.
    first = np.flatnonzero((text & 0xC0) != 0x80)
    size = np.diff(np.r_[first, len(text)])
    bare = np.repeat(whole[first] != size, size)
    at = np.flatnonzero(bare)
    sources.append(state[at])
    targets.append(state[at] + 1)
    ids.append(v.of_byte[text[at]])
    sources, targets, ids = map(np.concatenate, (sources, targets, ids))

    n_states = len(text) + len(units)
    start = (np.cumsum(sizes + 1) - (sizes + 1)).astype(np.int32)
    order = np.argsort(targets, kind="stable")  # one ascending run for each length, so little work
    sources, targets, ids = sources[order], targets[order], ids[order]
    weights = v.weights[ids]
    offset = (targets - np.repeat(start, sizes + 1)[targets]).astype(np.uint16)  # a unit has at most 804 bytes
    forward = np.full(n_states, -np.inf)
    forward[start] = 0.0
    order = np.argsort(offset, kind="stable")
    offset, from_, to_, weight_ = offset[order], sources[order], targets[order], weights[order]
    steps = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1], True]) if len(offset) else np.array([0])
    for a, b in zip(steps[:-1], steps[1:]):
        to = to_[a:b]
        group = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        forward[to[group]] = np.logaddexp.reduceat(forward[from_[a:b]] + weight_[a:b], group)
    reached = np.isfinite(forward[sources])
    if not reached.all():
        sources, targets, ids, weights = (x[reached] for x in (sources, targets, ids, weights))
    share = np.exp(forward[sources] + weights - forward[targets])
    group = np.flatnonzero(np.r_[True, targets[1:] != targets[:-1]])
    total = np.cumsum(share)
    before = np.r_[0.0, total][group]
    running = total - np.repeat(before, np.diff(np.r_[group, len(targets)]))
    running[np.r_[group[1:], len(targets)] - 1] = 1.0
    # The places of one unit follow those of another, so the edges of all blocks stand in order of their states.
    marks = (targets + state0) + np.minimum(running, 1.0)
    return sources + np.int32(state0), ids, marks, start + np.int32(state0), (start + sizes + state0).astype(np.int32)


def _char_size(first: np.ndarray) -> np.ndarray:
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def encode(texts: list[str], keys: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of one drawn segmentation of each text."""
    types: dict[str, int] = {}
    found = [[types.setdefault(u, len(types)) for u in _UNITS.findall(t)] for t in texts]
    counts = np.array([len(f) for f in found])
    if not counts.sum():
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    of_type = np.fromiter((u for f in found for u in f), dtype=np.int32, count=int(counts.sum()))
    del found
    sources, ids, marks, starts, lasts = _lattice([u.encode("utf-8") for u in types], v)
    seeds = np.array([zlib.crc32(k.encode()) | zlib.crc32(b"row" + k.encode()) << 32 for k in keys], dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(of_type)) - np.repeat(np.cumsum(counts) - counts, counts)
    seed = _splitmix(seeds[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin, at = starts[of_type], lasts[of_type]
    drawn, step = [], 0
    active = np.arange(len(of_type), dtype=np.int32)
    lengths = np.zeros(len(of_type), dtype=np.int32)
    while len(active):
        noise = _splitmix(seed[active] + np.uint64((step + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        uniform = (noise >> np.uint64(20)).astype(np.float64) * 2.0 ** -44
        edge = np.searchsorted(marks, at[active] + uniform, side="right")
        drawn.append((active, ids[edge].astype(np.int32)))
        at[active] = sources[edge]
        lengths[active] += 1
        active = active[at[active] > begin[active]]
        step += 1
    ends = np.cumsum(lengths, dtype=np.int64)
    result = np.empty(int(ends[-1]), dtype=np.int32)
    for back, (of, piece) in enumerate(drawn):
        result[ends[of] - 1 - back] = piece
    return np.split(result, ends[np.cumsum(counts) - 1][:-1]) if counts.all() else _split(result, ends, counts)


def _split(result: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    edges = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    return [result[a:b] for a, b in zip(edges[:-1], edges[1:])]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    return b"".join([v.pieces[i] for i in ids.tolist()]).decode("utf-8")


def _batches(texts) -> Iterator[slice]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def codec(spark: SparkSession, path: str):
    """Column functions ``coded(text, key)``, pieces and the text decoded from them, and ``decoded(ids)``.

    The vocabulary is of fixed size, so it is broadcast.
    """
    own = vocabulary(path)
    # As plain values, since a broadcast names its classes by module.
    shared = spark.sparkContext.broadcast((own.pieces, own.weights, own.of_byte, own.by_length, own.prefixes))

    @F.pandas_udf("pieces array<int>, decoded string")
    def coded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(*shared.value)
        for texts, keys in batches:
            for part in _batches(texts):  # a result for each part, so that little is held at once
                ids = encode(texts.iloc[part].tolist(), keys.iloc[part].tolist(), v)
                yield pd.DataFrame({"pieces": ids, "decoded": [decode(i, v) for i in ids]})

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(*shared.value)
        for ids in batches:
            yield pd.Series([decode(i, v) for i in ids], dtype=object)

    return coded, decoded


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def with_pieces(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` nested under ``row``, with ``pieces`` and the text ``decoded`` from them.

    A null text counts as empty and has no pieces; a null key is a key of its own; rows
    of equal text and key are cut alike. A very long text is worked on whole, in memory that
    grows with it. An empty table gives no rows.
    """
    coded, _ = codec(docs.sparkSession, path or default_path())
    row_key: Column = F.coalesce(F.concat(F.lit("="), quoted(key).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       coded(text_or_empty(text), row_key).alias("_coded"))
    return rows.select("row", "_coded.pieces", "_coded.decoded")


def op6_sentencepiece(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_pieces(docs).select(
        "row.doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("lossless"))
