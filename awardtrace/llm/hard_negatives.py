"""Hard-negative mining by a secondary-sort shuffle.

The anchors, in blocks, are scored against all rows, in blocks. A first scoring finds each
anchor's positives, a second one the rows that may be negatives of one of them; both
leave a few rows per anchor and block before anything is shuffled. These go to the task of
their anchor, sorted by (anchor, descending score, id): a positive opens a window when
the stream comes to it, rows of other labels behind it are given to the open windows.
No anchor's rows are ever held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import quoted, stage

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and not above it.
LEAST = 80
#: Rows and anchors of a block, and the numbers in it; anchors that are scored against a block at once.
BLOCK_ROWS, BLOCK_ANCHORS, BLOCK_CELLS = 8192, 4096, 4_000_000
AT_ONCE = 256

_LONG = np.iinfo(np.int64)
_EXACT = float(2 ** 53)
_BLOCK = "size int, dim int, kind string, ids binary, labels binary, cells binary"


def _packed(ids: np.ndarray, labels: np.ndarray, cells: np.ndarray) -> dict:
    """The columns of a block; cells take the smallest type that holds them."""
    most = np.abs(cells).max(initial=0)
    kind = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
    return {"size": len(ids), "dim": cells.shape[1], "kind": kind, "ids": ids.astype("<i8").tobytes(),
            "labels": labels.astype("<i8").tobytes(), "cells": np.ascontiguousarray(cells, dtype=kind).tobytes()}


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = np.frombuffer(row.cells, dtype=row.kind).astype(np.float64).reshape(row.size, row.dim)
    return np.frombuffer(row.ids, dtype="<i8"), np.frombuffer(row.labels, dtype="<i8"), cells


def _cells(vectors: list) -> np.ndarray:
    """floor(256 * x) of every component, as doubles; a shorter vector ends in zeros."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        cells = np.array(vectors, dtype=np.float64).reshape(len(vectors), width)
    else:
        cells = np.zeros((len(vectors), width))
        for row, v in zip(cells, vectors):
            row[:len(v)] = v
    return np.floor(256.0 * cells)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond 64 bits become the nearest that are not."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, rows))
    if np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(width, 1) < _EXACT:
        return (anchors @ rows.T).astype(np.int64)  # every sum on the way is a whole number below 2 ** 53
    exact = np.array([[int(x) for x in a] for a in anchors], dtype=object).reshape(anchors.shape)
    products = exact @ np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(rows.shape).T
    return np.clip(products, _LONG.min, _LONG.max).astype(np.int64)


def taking_part(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``id, label, vector`` of the rows with a label and a vector of finite numbers only."""
    own = rows.select(quoted(key).cast("long").alias("id"), quoted(label).cast("long").alias("label"),
                      quoted(vector).cast("array<double>").alias("vector"))
    unfit = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~unfit)


def blocks(rows: DataFrame) -> DataFrame:
    """``block``, its number from 0 on and its packed rows, by id; no block is larger than its bounds."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, int(df["vector"].map(len).max() if len(df) else 1))))
            for at in range(0, len(df), most):
                # A missing id stands behind all others.
                part = df.iloc[at:at + most].sort_values("id", na_position="last", kind="stable")
                ids = part["id"].fillna(_LONG.max).to_numpy(dtype=np.int64)
                yield pd.DataFrame([_packed(ids, part["label"].to_numpy(dtype=np.int64), _cells(part["vector"].tolist()))])

    # Ids go over as whole numbers: a column with nulls would turn into doubles.
    whole = rows.select(F.coalesce("id", F.lit(_LONG.max)).alias("id"), "label", "vector")
    packed = whole.mapInPandas(pack, _BLOCK)
    made = stage(packed.withColumn("block", F.monotonically_increasing_id()), "mining-blocks")
    counted = made.groupBy(F.shiftright("block", 33).alias("part")).agg(F.count("*").alias("n"))  # a row per task
    before = counted.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = made.withColumn("part", F.shiftright("block", 33)).join(F.broadcast(before), "part")
    number = F.col("before") + F.col("block").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("number", number.cast("int")).drop("part", "before")


def anchor_blocks(made: DataFrame, every: int) -> DataFrame:
    """``bucket`` and the packed anchors of it, with the block and the place that each stands at."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                ids, labels, cells = _unpacked(row)
                at = np.flatnonzero((ids % every == 0) & (ids != _LONG.max))
                yield pd.DataFrame({"home": row.block, "at": at, "id": ids[at], "label": labels[at],
                                    "cells": [c.tobytes() for c in cells[at]]})

    anchors = stage(made.mapInPandas(choose, "home long, at int, id long, label long, cells binary"), "mining-anchors")
    buckets = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    return anchors.withColumn("bucket", F.pmod(F.xxhash64("home", "at"), F.lit(buckets)).cast("int"))


def _gathered(anchors: DataFrame, extra: str = "") -> DataFrame:
    """A packed row per bucket of at most some BLOCK_ANCHORS anchors; ``extra`` names a column of numbers to keep."""
    def pack(df: pd.DataFrame) -> pd.DataFrame:
        vectors = [np.frombuffer(c, dtype=np.float64) for c in df["cells"]]
        width = max(map(len, vectors))
        cells = np.zeros((len(vectors), width))
        for row, v in zip(cells, vectors):
            row[:len(v)] = v
        out = _packed(df["id"].to_numpy(dtype=np.int64), df["label"].to_numpy(dtype=np.int64), cells)
        out |= {"bucket": df["bucket"].iloc[0], "home": df["home"].to_numpy(dtype="<i8").tobytes(),
                "at": df["at"].to_numpy(dtype="<i8").tobytes(), "tops": b""}
        if extra:
            tops = np.full((len(df), POSITIVES), _LONG.min, dtype="<i8")
            for row, own in zip(tops, df[extra]):
                row[:len(own)] = own
            out["tops"] = tops.tobytes()
        return pd.DataFrame([out])

    # A bucket is bounded, so that it may be one group.
    return anchors.groupBy("bucket").applyInPandas(pack, f"bucket int, {_BLOCK}, home binary, at binary, tops binary")


def _met(made: DataFrame, anchors: DataFrame, found, schema: str) -> DataFrame:
    """What ``found`` makes of every block of rows and every block of anchors.

    The stated anchors against all rows, block by block: each pair of blocks has a key
    of its own, so the pairs spread over the tasks.
    """
    anchors = stage(anchors, "mining-anchor-blocks")
    buckets, salts = (df.agg(F.max(c)).first()[0] or 0 for df, c in ((anchors, "bucket"), (made, "number")))
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(int(most))))
    left = made.withColumn("bucket", numbers(buckets))
    right = anchors.select("bucket", *[F.col(c).alias("a_" + c) for c in anchors.columns if c != "bucket"])
    right = right.withColumn("number", numbers(salts)).hint("merge")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                yield from found(row)

    return left.join(right, ["bucket", "number"]).mapInPandas(meet, schema)


def _best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best fitting columns of each row; of equal scores the first columns count."""
    n = score.shape[1]
    if np.abs(score.astype(np.float64)).max(initial=0) > 2.0 ** 60 / max(n, 1):
        score = np.unique(score, return_inverse=True)[1].reshape(score.shape)  # their order is all that counts
    order = np.where(fits, score * n + (n - 1 - np.arange(n)), _LONG.min)
    top = np.argpartition(order, n - k, axis=1)[:, n - k:] if n > k else np.tile(np.arange(n), (len(score), 1))
    rows, columns = np.repeat(np.arange(len(score)), top.shape[1]), top.ravel()
    keep = fits[rows, columns]
    return rows[keep], columns[keep]


def _anchors_of(row) -> tuple[np.ndarray, ...]:
    cells = np.frombuffer(row.a_cells, dtype=row.a_kind).astype(np.float64).reshape(row.a_size, row.a_dim)
    numbers = [np.frombuffer(x, dtype="<i8") for x in (row.a_ids, row.a_labels, row.a_home, row.a_at, row.a_tops)]
    return (*numbers, cells)


_PAIR = "home long, at int, anchor_id long, score long, id long, block long, place int"


def _pairs(row, anchor: np.ndarray, ids, home, at, score, other, other_ids) -> pd.DataFrame:
    return pd.DataFrame({"home": home[anchor], "at": at[anchor], "anchor_id": ids[anchor], "score": score,
                         "id": other_ids[other], "block": row.block, "place": other})


def _alike(row) -> Iterator[pd.DataFrame]:
    """Of each anchor's other rows of its label in a block the first ones."""
    ids, labels, home, at, _, cells = _anchors_of(row)
    other_ids, other_labels, others = _unpacked(row)
    for label in np.intersect1d(labels, other_labels):
        mine, same = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
        for own in np.split(mine, range(AT_ONCE, len(mine), AT_ONCE)):
            score = scores(cells[own], others[same])
            itself = (home[own] == row.block)[:, None] & (at[own][:, None] == same)
            r, c = _best(score, ~itself, POSITIVES)
            yield _pairs(row, own[r], ids, home, at, score[r, c], same[c], other_ids)


def _unlike(row) -> Iterator[pd.DataFrame]:
    """Of each anchor's rows of other labels in a block the first ones within the window of one of its positives."""
    ids, labels, home, at, tops, cells = _anchors_of(row)
    tops = tops.reshape(-1, POSITIVES)
    other_ids, other_labels, others = _unpacked(row)
    for own in np.split(np.arange(len(ids)), range(AT_ONCE, len(ids), AT_ONCE)):
        score = scores(cells[own], others)
        differs = labels[own][:, None] != other_labels
        found = []
        for top in tops[own].T:
            least = np.array([-(-LEAST * int(t) // 100) for t in top])  # rounded up
            fits = differs & (score <= top[:, None]) & (score >= least[:, None]) & (top != _LONG.min)[:, None]
            r, c = _best(score, fits, NEGATIVES)
            found.append(r * len(others) + c)
        r, c = np.divmod(np.unique(np.concatenate(found)), max(len(others), 1))
        yield _pairs(row, own[r], ids, home, at, score[r, c], c, other_ids)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (anchor, descending score, kind, id): positives open windows, negatives fill them."""
    anchor, windows = None, []
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for df in batches:
        out = []
        for home, at, anchor_id, score, negative, own in zip(
                *(df[c].tolist() for c in ("home", "at", "anchor_id", "score", "negative", "id"))):
            if (home, at) != anchor:
                anchor, windows = (home, at), []
            if not negative:
                windows.append([own, score, 0])
                continue
            # No later row is above this one, so what is too far below a positive closes its window.
            windows = [w for w in windows if w[2] < NEGATIVES and LEAST * w[1] <= 100 * score]
            for window in windows:
                window[2] += 1
                out.append((anchor_id, window[0], window[2], own, window[1], score))
        yield pd.DataFrame(out, columns=columns)


def mine(rows: DataFrame, every: int = 100, key: str = "vec_id", label: str = "label",
         vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose key is divisible by ``every``. A score is the inner product
    of floor(256 * x) of the components, exact; beyond 64 bits it is the nearest long.
    A shorter vector counts as ending in zeros. Higher scores come first, of equal ones
    the smaller key, a missing one last. Rows without a label or with a vector that is
    null or has a null or non-finite component take no part. Rows that repeat are rows of
    their own: a copy of an anchor is a positive of it and another anchor. An anchor
    without positives, or a positive without negatives, gives no rows, nor does an empty
    table. Other columns, texts among them, are ignored.
    """
    made = blocks(taking_part(rows, key, label, vector))
    anchors = anchor_blocks(made, every)
    near = _met(made, _gathered(anchors), _alike, _PAIR)
    order = [F.desc("score"), "id", "block", "place"]
    first = Window.partitionBy("home", "at").orderBy(*order)  # a few rows per block
    positives = stage(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= POSITIVES).drop("rank"),
                      "mining-positives")
    tops = positives.groupBy("home", "at").agg(F.array_distinct(F.sort_array(F.collect_list("score"), False)).alias("tops"))
    with_tops = anchors.join(tops, ["home", "at"])
    negatives = _met(made, _gathered(with_tops, "tops"), _unlike, _PAIR)
    pairs = positives.withColumn("negative", F.lit(False)).unionByName(negatives.withColumn("negative", F.lit(True)))
    # A positive stands before negatives of its score, which lie in its window.
    packed = F.struct("home", "at", F.bitwise_not("score"), "negative", "id", "block", "place")
    sorted_pairs = pairs.withColumn("key", packed).repartition("home", "at").sortWithinPartitions("key")
    found = sorted_pairs.drop("key", "block", "place").mapInPandas(
        _windows, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    known = lambda c: F.when(F.col(c) != _LONG.max, F.col(c)).alias(c)
    return found.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Where the key is divisible by 7, the next label of ten."""
    label: Column = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select("vec_id", moved.alias("label"), "embedding")


def op13_hard_negatives(spark, sf_dir):
    return mine(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP13_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, e.r AS r, e.vec_id AS id, a.label = e.label AS same,
         list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, r) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.id NULLS LAST, s.r) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
