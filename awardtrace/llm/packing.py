"""Packing by minimum bin slack.

Documents become token ids with an end id. What fills whole windows is cut off first;
the rest of each document is shorter than a window, so a histogram of at most
``WINDOW`` lengths stands for all of them. For each window a bitset of subset sums
picks the multiset of remaining lengths that comes closest to its capacity, the counts
are read back from the bitsets, and the same multiset is taken as often as the
histogram allows. A window that no multiset fills gets the head of a further rest, whose
tail goes back to the histogram. Rows then find their places by their rank among the
rests of their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, stage, text_or_empty

WINDOW = 1024
#: The tokenizer, and the same vocabulary as ranks of merges.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: The id behind every document.
END = 0
#: Texts with a run of so many characters without a break, or of so many blanks, go through the tokenizer itself.
LONG_RUN = 400
#: Characters that are encoded at once.
PART_CHARS = 1_000_000

_BLANK_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")



@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, once per worker that needs it."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True  # their strings in a text are ordinary text
    return exact


@lru_cache(maxsize=1)
def _encoder(path: str):
    """A faster encoder with the same vocabulary, once per worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut before a lone space between two letters, where no token crosses."""
    at = 0
    while len(text) - at > PART_CHARS:
        found = _BREAK.search(text, at + PART_CHARS)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def _short_runs(text: str) -> bool:
    """Whether no token is sought in a long run, where the faster encoder takes time with the square of it."""
    return max(map(len, text.split()), default=0) < LONG_RUN and not _BLANK_RUN.search(text)


def encode(text: str, tokenizer: str, ranks: str) -> np.ndarray:
    """The tokenizer's ids of a text and the end id."""
    ids: list[int] = []
    for part in _parts(text):
        ids += (_encoder(ranks).encode_ordinary(part) if _short_runs(part)
                else _tokenizer(tokenizer).encode(part, add_special_tokens=False).ids)
    ids.append(END)
    return np.array(ids, dtype="<u4")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


def tokenised(docs: DataFrame, paths: tuple[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_row, _key, n, ids``: a number of its own, the key, the number of ids and the ids of every row.

    ``ids`` holds 16-bit numbers, low byte first; the vocabulary fits. The table is
    written, since it is read again once the places are known.
    """
    tokenizer, ranks = paths or default_paths()

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode(t, tokenizer, ranks).astype("<u2").tobytes() for t in texts], dtype=object)

    rows = docs.select(quoted(key).alias("_key"), ids(text_or_empty(text)).alias("ids"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return stage(rows.select("_row", "_key", (F.octet_length("ids") / 2).cast("long").alias("n"), "ids"), "pack-tokens")


def closest(counts: np.ndarray, capacity: int) -> Counter:
    """How often each length is taken so that the sum comes as close to the capacity as it can.

    Bit s of a bitset tells whether a multiset of the lengths so far sums to s; the
    bitset of every step is kept, and the way back through them gives the counts.
    """
    mask, sums = (1 << (capacity + 1)) - 1, 1
    steps, before = [], []
    for length in np.flatnonzero(counts[:capacity + 1])[::-1].tolist():
        left, times = min(int(counts[length]), capacity // length), 1
        while left:  # 1, 2, 4, ... copies make up every number of them
            times = min(times, left)
            steps.append((length, times))
            before.append(sums)
            sums |= (sums << (length * times)) & mask
            left, times = left - times, 2 * times
        if sums >> capacity:
            break
    at, taken = sums.bit_length() - 1, Counter()
    for (length, times), known in zip(reversed(steps), reversed(before)):
        if not known >> at & 1:
            at -= length * times
            taken[length] += times
    return taken


@dataclass
class Plan:
    """Where the rests go: for each length, ranges of ranks and what happens to them.

    Ranks ``first`` to ``last`` of a length: ``times`` of them lie one behind the other in
    each sequence from ``sequence`` on, at ``offset``. If ``head`` is below the length,
    only the head of each does, and the tails are rests of their own length from the
    rank ``tail`` on.
    """

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Fill windows from a histogram of rests (lengths from 1 to ``window`` - 1).

    All windows but the last are full. What is left for the last one goes into sequences
    of powers of two, which need no padding.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = int((counts * np.arange(window + 1)).sum())
    used, made = np.zeros_like(counts), counts.copy()  # ranks given away and ranks there are, by length
    entries, sequence = [], 0
    while total:
        capacity = window if total >= window else 1 << (total.bit_length() - 1)
        fitting = np.flatnonzero(counts[:capacity + 1])
        taken: Counter = Counter()
        if len(fitting):  # the largest rest is hardest to place, so it comes first
            seed = int(fitting[-1])
            counts[seed] -= 1
            taken = closest(counts, capacity - seed)
            counts[seed] += 1
            taken[seed] += 1
        slack = capacity - sum(length * n for length, n in taken.items())
        need = Counter(taken)
        if slack:  # every rest that is left is longer than the slack
            left = counts.copy()
            for length, n in taken.items():
                left[length] -= n
            cut = int(np.flatnonzero(left)[-1])
            need[cut] += 1
        again = min(int(counts[length]) // n for length, n in need.items())
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            first = int(used[length])
            entries.append((length, first, first + n * again, n, sequence, offset, length, 0))
            used[length] += n * again
            counts[length] -= n * again
            offset += n * length
        if slack:
            first, rest = int(used[cut]), cut - slack
            entries.append((cut, first, first + again, 1, sequence, offset, slack, int(made[rest])))
            used[cut] += again
            counts[cut] -= again
            made[rest] += again
            counts[rest] += again
        sequence += again
        total -= again * capacity
    columns = np.array(sorted(entries), dtype=np.int64).reshape(-1, 8).T
    return Plan(*columns, sequences=sequence)


def places(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """``of, start, length, sequence, offset`` of the pieces of rests given by length and rank; ``of`` is the rest."""
    order = (plan.length << 44) + plan.first
    of, start = np.arange(len(length)), np.zeros(len(length), dtype=np.int64)
    found = []
    while len(of):
        at = np.searchsorted(order, (length << 44) + rank, side="right") - 1
        place = rank - plan.first[at]
        head = plan.head[at]
        found.append((of, start, head, plan.sequence[at] + place // plan.times[at],
                      plan.offset[at] + place % plan.times[at] * length))
        cut = head < length
        of, start = of[cut], (start + head)[cut]
        rank, length = (plan.tail[at] + place)[cut], (length - head)[cut]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (of, start, start, start, start)


def _ranked(tokens: DataFrame, window: int) -> DataFrame:
    """Rows in the order of (rest, row) with their place and the whole windows before them, both within ``part``."""
    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, windows = TaskContext.get().partitionId(), 0, 0
        for df in batches:
            ends = windows + df["windows"].to_numpy().cumsum()
            yield df.assign(part=part, place=np.arange(rows, rows + len(df)), windows_before=ends - df["windows"])
            if len(df):
                rows, windows = rows + len(df), int(ends[-1])

    narrow = tokens.select("_row", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("windows"))
    ranged = narrow.repartitionByRange("rest", "_row").sortWithinPartitions("rest", "_row")
    columns = "_row long, rest long, windows long, part int, place long, windows_before long"
    return stage(ranged.mapInPandas(numbered, columns), "pack-order")


def packed(docs: DataFrame, window: int = WINDOW, paths: tuple[str, str] | None = None, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """One row per piece: ``key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    A row's ids are those of its text and an end id; each lies in exactly one piece.
    ``ids`` is binary, 16 bits an id, low byte first; the check sum is that of the ids as
    32-bit numbers, low byte first. All sequences have ``window`` ids but a few at the
    end, whose numbers are different powers of two below it. A null text counts as empty
    and is one end id; a very long one is encoded in parts cut where no token crosses, and
    fills whole windows. Rows are packed one by one, also those that repeat or lack a key;
    the key decides nothing. An empty table gives no rows. Other columns are ignored.
    """
    tokens = tokenised(docs, paths, text, key)
    ordered = _ranked(tokens, window)
    histogram = {r.rest: r.n for r in ordered.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # <= window rows
    places_of = plan({rest: n for rest, n in histogram.items() if rest}, window)
    first = np.zeros(window, dtype=np.int64)  # the place of the first row of each rest
    first[1:] = np.cumsum([histogram.get(rest, 0) for rest in range(window - 1)])
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.sum("windows").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                         F.coalesce(F.sum("all").over(before), F.lit(0)).alias("all_before"))

    @F.pandas_udf("array<struct<start:long,length:long,ids:binary,ids_crc32:long,sequence_id:long,offset:long>>")
    def pieces(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            rest, place, windows, sequence = (c.to_numpy(dtype=np.int64) for c in batch[:4])
            whole = np.repeat(np.arange(len(rest)), windows)
            nth = np.arange(len(whole)) - np.repeat(np.cumsum(windows) - windows, windows)
            some = np.flatnonzero(rest)
            of, start, size, at, offset = places(places_of, rest[some], place[some] - first[rest[some]])
            of = some[of]
            columns = [np.r_[whole, of], np.r_[nth * window, windows[of] * window + start],
                       np.r_[np.full(len(whole), window), size], np.r_[sequence[whole] + nth, at],
                       np.r_[np.zeros(len(whole), dtype=np.int64), offset]]
            ids, out = batch[4].tolist(), [[] for _ in range(len(rest))]
            for i, s, n, q, o in zip(*(c.tolist() for c in columns)):
                own = ids[i][2 * s:2 * (s + n)]
                out[i].append({"start": s, "length": n, "ids": own, "ids_crc32": ids_crc32(own), "sequence_id": q, "offset": o})
            yield pd.Series(out, dtype=object)

    placed = ordered.join(F.broadcast(parts), "part").select(
        "_row", "rest", "windows", (F.col("rows_before") + F.col("place")).alias("place"),
        (F.col("all_before") + F.col("windows_before") + places_of.sequences).alias("first_sequence"))
    cut = tokens.join(placed, "_row").withColumn("p", pieces("rest", "place", "windows", "first_sequence", "ids"))
    return cut.select("_key", "n", F.explode("p").alias("p")).select(
        F.col("_key").alias(key), "p.start", "p.length", "p.ids", "p.ids_crc32", F.col("n").alias("doc_tokens"),
        "p.sequence_id", "p.offset")


def ids_of(packed_ids: bytes) -> np.ndarray:
    """The ids of a piece."""
    return np.frombuffer(packed_ids, dtype="<u2")


def ids_crc32(packed_ids: bytes) -> int:
    """CRC-32 of the ids as 32-bit numbers, low byte first."""
    return zlib.crc32(ids_of(packed_ids).astype("<u4").tobytes())


def op12_packing(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return packed(docs).drop("ids")
