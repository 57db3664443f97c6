"""N-gram Jaccard join with signature trees.

Sets that link share one of their rarest shingles, as many as a set may lack and still
link. Documents meet under those shingles only, each with its size and bitmap; the shingle's
place in both, and bitmaps in lists or trees, drop the pairs that cannot share enough. What is left ties sets into classes
that no link leaves. A class is dealt out in blocks by size, each of which gets its whole
sets, once, and a second walk of trees with exact counts gives the components of each
block. One set of each component meets those of other blocks, which joins most of what
belongs together. Where several components are left, blocks of fitting sizes meet as
bitmaps, and of these only the sets that a bound lets through to another component meet
whole. Equal sets are one set throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, stage, text_or_empty
from awardtrace.llm.components import components
from awardtrace.llm.shingles import Sets, blocks, in_order, sets_of, shingle_sets
from awardtrace.llm.signature_tree import Classes, bitmap, folded, most_shared, needed, walk, width_for
from awardtrace.operators.joins import skew_join

#: Rows drawn to rank common shingles: a share of the table, since a shingle's rows grow with it, but some at least and at most;
#: and how many are ranked. The ranks only decide which shingles are tried first.
SAMPLE_SHARE, SAMPLE_ROWS, SAMPLE_MOST = 0.02, 5_000, 100_000
RANKED = 200_000
#: Sets under one shingle that are compared there. Under a shingle with more, all become one class at once, which costs
#: more checks later and changes no result.
RUN = 1024
#: Of runs up to so many sets, pairs of a fitting size are listed, so many at once; longer ones have trees.
SHORT, PAIRS = 256, 1_000_000
#: A class is dealt out in blocks of some so many sets and shingles; so many blocks meet as one with others.
BLOCK_SETS, BLOCK_TOKENS, TOGETHER = 256, 400_000, 8
#: Bits of the filter for the documents whose sets are read again; a fixed size, so it may be broadcast.
FILTER_BITS = 23
_BUFFER = 100_000


class Ranks:
    """Ranks of common shingles, from their sorted hashes and their counts; 0 for any other."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = hashes, np.minimum(counts, 0xFFFF)
        self.last = np.uint64((1 << 20) - 1)
        self.slots = np.zeros(1 << 20, dtype=bool)  # most shingles have no rank, and nearly all of these are told by their last bits
        self.slots[hashes & self.last] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(tokens), dtype=np.int64)
        at = np.flatnonzero(self.slots[tokens & self.last])
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, tokens[at]), len(self.hashes) - 1)
            rank[at] = np.where(self.hashes[place] == tokens[at], self.counts[place], 0)
        return rank


def _prefixes(sets: Sets, ranks: Ranks, num: int, den: int) -> pa.Array:
    """The shingles under which each set is found: as many of its rarest as it may lack and still link, and one more.

    They go by rank, then hash, so two shingles have one order in all sets.
    """
    sizes = sets.sizes
    keep = np.where(sizes > 0, sizes + (-num * sizes) // den + 1, 0)
    order = in_order(ranks.of(sets.tokens))
    order = order[in_order(sets.rows[order])]
    place = np.arange(len(sets.tokens)) - np.repeat(sets.ends[:-1], sizes)
    return _listed(np.r_[0, np.cumsum(keep)], sets.tokens[order][place < np.repeat(keep, sizes)])


def _name(tokens: np.ndarray) -> bytes:
    """What a set is known by."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _listed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(ends.astype(np.int32), values.view(np.int64))


def _ranks(docs: DataFrame, n: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order, with their counts in a sample: at most RANKED."""
    @F.arrow_udf("array<long>")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sets = [shingle_sets(block, n) for block in blocks(batch)]
            yield _whole([_listed(s.ends, s.tokens) for s in sets], pa.list_(pa.int64()))

    rows = max(1, docs.count())
    wanted = min(SAMPLE_MOST, max(SAMPLE_ROWS, SAMPLE_SHARE * rows))
    drawn = docs.sample(fraction=min(1.0, wanted / rows), seed=5)
    counted = drawn.select(F.explode(tokens(text_or_empty(text))).alias("token")).groupBy("token").count()
    top = counted.where("count > 3").orderBy(F.desc("count"), "token").limit(RANKED).toPandas()
    hashes = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["count"].to_numpy(dtype=np.int64)[order]


def _whole(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([part.cast(kind) for part in parts]) if parts else pa.array([], kind)


def described(docs: DataFrame, n: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """``_key, n, set, prefix, bits`` of every row: size, identity, rarest shingles and bitmap of its set."""
    ranked, counts = _ranks(docs, n, text)

    @F.arrow_udf("n long, set binary, prefix array<long>, bits binary")
    def describe(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = Ranks(ranked, counts)
        for batch in texts:
            columns = [[], [], [], []]
            for block in blocks(batch):
                sets = shingle_sets(block, n)
                own = [sets.sizes, [_name(own) for own in sets], _prefixes(sets, ranks, num, den), sets.bitmaps()]
                for column, part in zip(columns, own):
                    column.append(pa.array(part))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.StructArray.from_arrays([_whole(c, k) for c, k in zip(columns, kinds)], names=["n", "set", "prefix", "bits"])

    return docs.select(quoted(key).alias("_key"), describe(text_or_empty(text)).alias("d")).select("_key", "d.*")


def _runs(tokens: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True])


def _pairs(df: pd.DataFrame, runs: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the runs whose sets may link under the shingle, the smaller set first; some at a time.

    Rows stand by size in a run, so the sets of a fitting size follow one another. Of two sets that
    link, all they share stands from the first shared shingle on: under that one, neither may have
    less left than they must share. (Without ``pos``, the shingle's place in each set's order, all are left.)
    """
    n = df["n"].to_numpy(dtype=np.int64)
    left = n - df["pos"].to_numpy(dtype=np.int64) if "pos" in df else n
    length = runs[:, 1] - runs[:, 0]
    own = np.repeat(np.arange(len(runs)), length)
    at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(runs[:, 0], length)
    most = int(n[at].max(initial=0)) + 1
    upto = np.searchsorted(own * most + n[at], own * most + np.minimum(n[at] * den // num, most - 1), side="right")
    count = upto - np.arange(len(at)) - 1
    ends = np.cumsum(count)
    first = 0
    while first < len(at):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        c = count[first:last]
        i = np.repeat(np.arange(first, last), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        i, j, first = at[i], at[j], last
        fits = np.minimum(left[i], left[j]) >= needed(n[i], n[j], num, den)
        if fits.any():
            yield i[fits], j[fits]


def _met(num: int, den: int):
    """Of rows sorted by (token, n) those that may link with another set under the token.

    The first and the last run of a task stay whole, as they may go on elsewhere, and so
    does a run that fills the buffer or has more sets than are compared there.
    """
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, first, long_token = None, True, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest) < _BUFFER:
                continue
            tokens = rest["token"].to_numpy()
            edges = _runs(tokens)
            cut = edges[-2]  # the last run may go on
            if cut:
                yield fitting(rest.iloc[:cut].reset_index(drop=True), edges[:-1], first, long_token)
                first, rest = False, rest.iloc[cut:]
            if len(rest) >= _BUFFER:  # a run that fills the buffer stays whole, and so does what follows of it
                long_token, first = rest["token"].iloc[-1], False
                yield rest
                rest = None
        if rest is not None and len(rest):
            rest = rest.reset_index(drop=True)
            edges = _runs(rest["token"].to_numpy())
            cut = edges[-2]
            if cut:
                yield fitting(rest.iloc[:cut], edges[:-1], first, long_token)
            yield rest.iloc[cut:]

    def fitting(df: pd.DataFrame, edges: np.ndarray, first: bool, long_token) -> pd.DataFrame:
        runs = np.c_[edges[:-1], edges[1:]]
        length = runs[:, 1] - runs[:, 0]
        whole = length > RUN
        if first:
            whole[0] = True
        if long_token is not None:
            whole |= df["token"].to_numpy()[runs[:, 0]] == long_token
        keep = np.repeat(whole, length)
        for i, j in _pairs(df, runs[~whole & (length > 1)], num, den):
            keep[i] = keep[j] = True
        return df[keep]

    return met


def _small_runs(df: pd.DataFrame, runs: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs in short runs that their bitmaps let through, as positions."""
    sizes, bits = df["n"].to_numpy(dtype=np.int64), df["bits"].to_numpy()
    width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    row, maps = np.zeros(len(bits), dtype=np.int64), {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        maps[int(w)] = np.frombuffer(b"".join(bits[at]), dtype=np.uint64).reshape(len(at), -1)
    for i, j in _pairs(df, runs, num, den):
        for w in np.unique(width[i]).tolist():
            for wider in (False, True):
                pick = (width[i] == w) & (width[j] == (2 * w if wider else w))
                a, b = i[pick], j[pick]
                step = max(1, PAIRS // w)
                for s in range(0, len(a), step):
                    p, q = a[s:s + step], b[s:s + step]
                    other = folded(maps[2 * w][row[q]]) if wider else maps[w][row[q]]
                    good = most_shared(sizes[p], maps[w][row[p]], sizes[q], other) >= needed(sizes[p], sizes[q], num, den)
                    yield p[good], q[good]


def _long_run(df: pd.DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A set of each class of a longer run against its members; a tree for each width, and for it with the next one."""
    classes = Classes(len(df))
    for at, maps, sizes, first in _common_widths(df):
        local = Classes(len(at))
        walk(sizes, maps, num, den, local, first=first)
        for k, label in enumerate(local.label):
            classes.join(int(at[k]), int(at[label]))
    return np.arange(len(df)), classes.label


def _vertex(token: np.ndarray) -> np.ndarray:
    """A vertex for a shingle itself, below all set numbers."""
    return -1 - (token & np.int64(0x7FFFFFFFFFFFFFFF))


def _ties(num: int, den: int):
    """Edges that tie all sets into one class which may link under a shingle."""
    def edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        apart = a != b
        return pd.DataFrame({"u": a[apart], "v": b[apart]}).drop_duplicates()

    def ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, first, last_long = None, True, None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest) < _BUFFER:
                continue
            cut = _runs(rest["token"].to_numpy())[-2]
            if cut == 0:  # one shingle fills the buffer
                yield to_vertex(rest)
                last_long, first, rest = rest["token"].iloc[-1], False, None
                continue
            yield from whole(rest.iloc[:cut].reset_index(drop=True), first, False, last_long)
            first, rest = False, rest.iloc[cut:]
        if rest is not None and len(rest):
            yield from whole(rest.reset_index(drop=True), first, True, last_long)

    def to_vertex(df: pd.DataFrame) -> pd.DataFrame:
        return edges(df["sid"].to_numpy(dtype=np.int64), _vertex(df["token"].to_numpy(dtype=np.int64)))

    def whole(df: pd.DataFrame, first: bool, last: bool, last_long) -> Iterator[pd.DataFrame]:
        tokens, sid = df["token"].to_numpy(dtype=np.int64), df["sid"].to_numpy(dtype=np.int64)
        marks = _runs(tokens)
        runs = np.c_[marks[:-1], marks[1:]]
        length = runs[:, 1] - runs[:, 0]
        # Runs at the edge of a task may go on in the next one, so they meet at the shingle's own vertex.
        shared = (length > RUN) | (tokens[runs[:, 0]] == last_long if last_long is not None else False)
        if first:
            shared[0] = True
        if last:
            shared[-1] = True
        for a, b in runs[shared]:
            yield to_vertex(df.iloc[a:b])
        short = ~shared & (length <= SHORT)
        for i, j in _small_runs(df, runs[short], num, den):
            yield edges(sid[i], sid[j])
        for a, b in runs[~shared & ~short]:
            i, j = _long_run(df.iloc[a:b], num, den)
            yield edges(sid[a + i], sid[a + j])

    return ties


def _classes(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``sid, class`` of all sets that may link with another one."""
    tokens = reps.select(F.posexplode("prefix").alias("pos", "token"), "sid", "n").select("token", "sid", "n", "pos")
    ranges = tokens.repartitionByRange("token", "sid").sortWithinPartitions("token", "n", "sid")
    met = ranges.mapInPandas(_met(num, den), "token long, sid long, n long, pos int")
    met = met.join(reps.select("sid", "bits"), "sid")
    met = met.repartitionByRange("token", "sid").sortWithinPartitions("token", "n", "sid")
    ties = met.select("token", "sid", "n", "pos", "bits").mapInPandas(_ties(num, den), "u long, v long")
    return components(ties).where("u >= 0").select(F.col("u").alias("sid"), F.col("component").alias("class"))


def _only(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the keys, by a filter of fixed size, so that few rows are shuffled afterwards."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = keys.select(slot(F.col("_key")).alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_bits"))
    mine = docs.withColumn("_slot", slot(quoted(key)))
    return mine.join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word")).where(
        F.getbit("_bits", (F.col("_slot") % 64).cast("int")) == 1).drop("_slot", "_word", "_bits")


def _common_widths(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in the order of size, their bitmaps at one width, sizes, and which have that width: for each width, with the next."""
    sizes, bits = df["n"].to_numpy(dtype=np.int64), df["bits"].to_numpy()
    width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        at = at[np.argsort(sizes[at], kind="stable")]
        maps = np.empty((len(at), w // 8), dtype=np.uint64)
        for k, p in enumerate(at):
            own = np.frombuffer(bits[p], dtype=np.uint64)
            maps[k] = own if width[p] == w else folded(own)
        yield at, maps, sizes[at], width[at] == w


def _joined_by(labels: np.ndarray) -> Classes:
    """Classes of positions by labels that they have already."""
    classes = Classes(len(labels))
    first: dict[int, int] = {}
    for i, label in enumerate(labels.tolist()):
        classes.join(first.setdefault(label, i), i)
    return classes


def _grouped(unit, names: tuple[str, ...] = ("class", "i", "j"), prepared=None):
    """``unit`` of every group of rows that stand together; ``prepared`` gets them before, many groups at a time."""
    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            batch = batch if prepared is None else prepared(batch)
            keys = list(zip(*(batch[c] for c in names)))
            edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and keys[a] != last:
                    yield unit(together(held))
                    held = []
                held.append(batch.iloc[a:b])
                last = keys[a]
        if held:
            yield unit(together(held))

    def together(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)

    return grouped


def _possible(num: int, den: int):
    """Within each (class, i, j): the sets that a bitmap lets link with one of another component."""
    def unit(df: pd.DataFrame) -> pd.DataFrame:
        labels, involved = df["comp"].to_numpy(dtype=np.int64), np.zeros(len(df), dtype=bool)
        for at, maps, sizes, first in _common_widths(df):
            def see(i: int, js: np.ndarray) -> np.ndarray:
                involved[at[i]] = True
                involved[at[js]] = True
                return np.zeros(len(js), dtype=bool)

            walk(sizes, maps, num, den, _joined_by(labels[at]), see, first=first)
        return df.loc[involved, ["class", "i", "j", "sid"]]

    return _grouped(unit)


def _exact(n: int, num: int, den: int, every: bool = False):
    """Within each (class, i, j): sets made anew from the texts, and a set of its component for each.

    Sets of one ``comp`` are joined already. With ``every`` all links instead, as pairs
    ``a, b`` of sets; two sets of one block may meet in several units of it, so their link
    comes from the unit of the block with itself.
    """
    def unit(df: pd.DataFrame) -> pd.DataFrame:
        sets = df["own"].tolist()
        at = np.flatnonzero(df["same"].to_numpy())  # another text under the same key is another set
        at = at[np.argsort([len(sets[p]) for p in at], kind="stable")]
        sets = [sets[p] for p in at]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        sid = df["sid"].to_numpy(dtype=np.int64)[at]
        own, apart = df["b"].to_numpy()[at], df["i"].iloc[0] != df["j"].iloc[0]
        classes, left, right = _joined_by(df["comp"].to_numpy(dtype=np.int64)[at]), [sid[:0]], [sid[:0]]

        def link(i: int, js: np.ndarray) -> None:
            if apart:
                js = js[own[js] != own[i]]
            left.append(np.full(len(js), sid[i]))
            right.append(sid[js])

        if len(sets) > 1:
            width = width_for(2 * int(sizes[-1]))
            maps = np.stack([bitmap(s, width) for s in sets])

            def check(i: int, js: np.ndarray) -> np.ndarray:
                others = np.concatenate([sets[j] for j in js])
                place = np.minimum(np.searchsorted(sets[i], others), len(sets[i]) - 1)
                shared = np.add.reduceat(sets[i][place] == others, np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
                return shared >= needed(sizes[i], sizes[js], num, den)

            walk(sizes, maps, num, den, classes, check, link=link if every else None)
        if every:
            return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
        return pd.DataFrame({"sid": sid, "root": sid[classes.label], "class": df["class"].iloc[0]})

    def prepared(batch: pd.DataFrame) -> pd.DataFrame:
        sets = sets_of(batch["_text"].tolist(), n)
        same = [_name(s) == bytes(k) for s, k in zip(sets, batch["set"])]
        return batch.drop(columns=["_text", "set"]).assign(own=pd.Series(sets, index=batch.index, dtype=object), same=same)

    return _grouped(unit, prepared=prepared)


def _blocked(members: DataFrame) -> DataFrame:
    """The members with their block ``b``: sets of like sizes, of one size by hash."""
    counts = members.groupBy("class", "n").agg(F.count("*").alias("c"))
    weight = F.greatest(F.col("c") / BLOCK_SETS, F.col("c") * F.col("n") / BLOCK_TOKENS)
    below = Window.partitionBy("class").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # a row per size
    bands = counts.withColumn("w", weight).select(
        "class", "n", F.floor(F.coalesce(F.sum("w").over(below), F.lit(0.0))).cast("int").alias("band"),
        F.ceil("w").cast("int").alias("parts"))
    placed = skew_join(members, bands, ["class", "n"])
    return placed.withColumn("b", F.col("band") + F.pmod(F.hash("sid"), F.col("parts"))).drop("band", "parts")


def _texts(docs: DataFrame, members: DataFrame, text: str, key: str) -> DataFrame:
    """Members, each with ``class, i, j``, beside the texts under their keys: what is dealt to the units."""
    own = _only(docs.select(quoted(key).alias("_key"), text_or_empty(text).alias("_text")), members, "_key")
    dealt = members.join(own, "_key").select("class", "i", "j", "b", "sid", "set", "comp", "_text")
    return dealt.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")


def _candidates(docs: DataFrame, n: int, num: int, den: int, text: str,
                key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, distinct sets, their representatives, and the members of each class in blocks."""
    rows = stage(described(docs, n, num, den, text, key), "join-sets")
    full = rows.where("n > 0 AND _key IS NOT NULL")
    sets = full.groupBy("set").agg(F.min("_key").alias("_key"))  # equal sets are combined on the map side
    # One row of each set, also where rows repeat; the join has dealt them by these columns already.
    reps = full.join(sets, ["set", "_key"]).dropDuplicates(["set", "_key"])
    reps = reps.withColumn("sid", F.monotonically_increasing_id())
    reps = stage(reps, "join-reps")
    classes = stage(_classes(reps, num, den), "join-classes")
    members = classes.join(reps.select("sid", "_key", "set", "n"), "sid")
    return rows, sets, reps, stage(_blocked(members), "join-members")


def _block_pairs(blocks: DataFrame, num: int, den: int, within: bool) -> DataFrame:
    """``class, i, j`` of blocks (``class, b, low, high``) some of whose sizes fit; ``within`` adds each with itself."""
    left = blocks.select("class", F.col("b").alias("i"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    right = blocks.select("class", F.col("b").alias("j"), "low", "high")
    fits = (F.least("_high", "high") * den >= F.greatest("_low", "low") * num) & (
        F.col("i") <= F.col("j") if within else F.col("i") < F.col("j"))
    return skew_join(left, right, ["class"]).where(fits).select("class", "i", "j")


def _sides(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members once for each pair of blocks that their own is in."""
    units = pairs.select("class", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    return skew_join(members, units, ["class", "b"])


def _roots(docs: DataFrame, reps: DataFrame, members: DataFrame, n: int, num: int, den: int, text: str,
           key: str) -> DataFrame:
    """``sid, root``: the component of every member."""
    def solved(of: DataFrame, name: str) -> DataFrame:
        return stage(_texts(docs, of, text, key).mapInPandas(_exact(n, num, den), "sid long, root long, class long"), name)

    alone = {"i": F.col("b"), "j": F.col("b"), "comp": F.col("sid")}
    found = solved(members.withColumns(alone), "join-blocks").distinct()
    several = members.groupBy("class").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    several = stage(several.select("class"), "join-several")
    if several.isEmpty():
        return found.select("sid", "root")
    # One set of each component of a block against those of other blocks, as long as that joins half of them.
    large = found.join(several, "class", "left_semi")
    edges, at, count = large.select("sid", "root"), large, None
    while True:
        chosen = at.select(F.col("root").alias("sid")).distinct()
        chosen = stage(_blocked(members.join(chosen, "sid", "left_semi").drop("b")).withColumns(alone), "join-chosen")
        before, count = count, chosen.count()
        if before is not None and 2 * count > before:
            break
        at = solved(chosen, "join-chosen-blocks")
        edges = edges.unionByName(at.select("sid", "root"))
    edges = edges.select(F.col("sid").alias("u"), F.col("root").alias("v"))
    own = components(edges).select(F.col("u").alias("sid"), F.col("component").alias("comp"))
    labelled = members.join(several, "class", "left_semi").join(own, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # Classes of several components yet: their blocks, some at a time, meet those of fitting sizes.
    split = labelled.groupBy("class").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("class")
    labelled = stage(labelled.join(split, "class", "left_semi").withColumn("b", F.floor(F.col("b") / TOGETHER).cast("int")),
                     "join-labelled")
    if not labelled.isEmpty():
        blocks = labelled.groupBy("class", "b").agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        pairs = _block_pairs(blocks, num, den, within=True)
        met = _sides(labelled, pairs).join(reps.select("sid", "bits"), "sid").select("class", "i", "j", "sid", "n", "bits", "comp")
        met = met.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")
        involved = stage(met.mapInPandas(_possible(num, den), "class long, i int, j int, sid long"), "join-involved").distinct()
        met = involved.join(labelled.drop("class"), "sid")
        joined = solved(met, "join-met")
        edges = edges.unionByName(joined.select(F.col("sid").alias("u"), F.col("root").alias("v")))
        own = components(edges).select(F.col("u").alias("sid"), F.col("component").alias("comp"))
    whole = found.join(own, "sid", "left")
    return whole.select("sid", F.coalesce("comp", "root").alias("root")).distinct()


def links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text",
          key: str = "doc_id") -> DataFrame:
    """``a, b, a_set, b_set``: every link between two different sets, once.

    A set is named by the smallest key of its rows (``members`` tells which rows have which
    set) and its hash; (a, a_set) is below (b, b_set), and a = b only where rows of one key
    have different texts that link. The pairs grow with the square of a group of near
    copies; ``linked`` gives the components without them.
    """
    _, _, reps, members = _candidates(docs, n, num, den, text, key)
    blocks = members.groupBy("class", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = _sides(members.withColumn("comp", F.col("sid")), _block_pairs(blocks, num, den, within=True))
    units = _texts(docs, met, text, key)
    # A key whose rows repeat with one text gives one set several times: they would meet themselves.
    once = units.dropDuplicates(["class", "i", "j", "sid", "_text"]).repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")
    pairs = once.mapInPandas(_exact(n, num, den, every=True), "a long, b long").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    name = lambda side: reps.select(F.col("sid").alias(side), F.struct("_key", "set").alias(f"_{side}"))
    pairs = pairs.join(name("a"), "a").join(name("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return pairs.select(F.col("a._key").alias("a"), F.col("b._key").alias("b"), F.col("a.set").alias("a_set"), F.col("b.set").alias("b_set"))


def members(docs: DataFrame, n: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, set, representative``: the set of every row and the smallest key of the rows that have it.

    With ``links`` this is every link: between rows of one set, and between rows of two sets
    that link. A row without a key or without words has no representative.
    """
    rows = stage(described(docs, n, 1, 1, text, key).drop("prefix", "bits"), "join-members")
    full = (F.col("n") > 0) & F.col("_key").isNotNull()
    least = rows.where(full).groupBy("set").agg(F.min("_key").alias("representative"))
    found = skew_join(rows, least, ["set"], "left")
    return found.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "set",
                        F.when(full, F.col("representative")).alias("representative"))


def linked(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    Two rows link if intersection / union of their sets of n-word shingles is at least
    num / den; a component is what links reach, named by its smallest key. A text of
    fewer words has all of them as its one shingle; a very long one is read whole and is one
    member of its block. Null and empty texts and texts without words have an empty set and link with nothing, so the component is the
    row's own key. Rows without a key have a size, link with nothing and have no
    component. An empty table gives no rows.
    """
    rows, sets, reps, dealt = _candidates(docs, n, num, den, text, key)
    roots = stage(_roots(docs, reps, dealt, n, num, den, text, key), "join-roots")
    roots = roots.join(reps.select("sid", "set", "_key"), "sid")
    least = roots.groupBy("root").agg(F.min("_key").alias("component_id"))
    named = skew_join(roots, least, ["root"]).select("set", "component_id")
    # Sets without a class stand alone: the smallest key of their copies names them.
    named = sets.join(named, "set", "left").select("set", F.coalesce("component_id", "_key").alias("component_id"))
    whole = skew_join(rows.select("_key", "n", "set"), named, ["set"], "left")
    component = F.when((F.col("n") > 0) & F.col("_key").isNotNull(), F.col("component_id")).otherwise(F.col("_key"))
    return whole.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text",
                key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key names their component, with its columns; rows without a key stay.

    One row stays of those with a key.
    """
    stays = linked(docs.select(quoted(key).alias(key), quoted(text).alias(text)), n, num, den, text, key)
    stays = stays.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_stays")).distinct()
    nested = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(key).alias("_key"))
    kept = nested.join(stays, F.col("_key") == F.col("_stays"), "left_semi").dropDuplicates(["_key"])
    return kept.unionByName(nested.where("_key IS NULL")).select("row.*")


def op1_ngram_jaccard_join(spark, sf_dir):
    return linked(documents(spark, sf_dir).select("doc_id", "text"), n=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
    END AS g FROM d),
sets AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
grams AS (SELECT rep, n, unnest(g) AS t FROM sets),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM grams AS a JOIN grams AS b ON a.t = b.t AND a.rep <> b.rep
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT rep, rep FROM sets UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
named AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM s LEFT JOIN sets ON s.g = sets.g LEFT JOIN named ON sets.rep = named.rep
"""
