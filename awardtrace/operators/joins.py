"""Joins that stay balanced when one key, or no key at all, holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that may be broadcast as a filter, after measuring them, and what a key costs besides its text.
BROADCAST_BYTES = 32_000_000
ROW_BYTES = 32

_HASH = "_key_hash"
_KEY = "_left_key"
_RIGHT = "_right_key"


def _small_hash(*on: str) -> Column:
    """One of 256 numbers that the key decides: as a further key it need not be unlike others, and costs a byte or two a row."""
    return F.hash(*on).bitwiseAND(F.lit(255))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", merge: bool = False) -> DataFrame:
    """Equi-join whose hot keys AQE can split, whatever comes before it.

    AQE splits a skewed partition only where both sides are shuffled for the join
    itself. A side that is grouped by the key already would be used as it is; the
    hash as a further key makes the planner shuffle it again. Such a side has one
    row per key, so this is the smaller part of the join. ``merge`` rules out a
    broadcast where Spark's size estimate is no proof.
    """
    key_hash = _small_hash(*on)
    right = right.withColumn(_HASH, key_hash)
    if merge:
        right = right.hint("merge")
    return left.withColumn(_HASH, key_hash).join(right, [*on, _HASH], how).drop(_HASH)


def _spread_key(key: str, spread_by: list[str]) -> Column:
    """The key, or for null a text of the row's own, so that such rows go to different tasks."""
    return F.coalesce(F.col(key), F.concat(F.lit("null "), F.xxhash64(*spread_by).cast("string")))


def _join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], how: str) -> DataFrame:
    keyed = left.withColumn(_KEY, _spread_key(key, spread_by)).withColumn(_HASH, _small_hash(_KEY))
    right = right.withColumnRenamed(key, _RIGHT).withColumn(_HASH + "_right", _small_hash(_RIGHT))
    # A null key never joins, whatever text stands in for it.
    on = (F.col(_KEY) == F.col(_RIGHT)) & (F.col(_HASH) == F.col(_HASH + "_right")) & F.col(key).isNotNull()
    return keyed.join(right, on, how).drop(_KEY, _HASH, _RIGHT, _HASH + "_right")


def left_join_spreading_nulls(left: DataFrame, right: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    return _join(left, right, key, spread_by, "left")


def anti_join_spreading_nulls(left: DataFrame, right: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    return _join(left, right, key, spread_by, "left_anti")


def keep_if_small_keys(df: DataFrame, keys: DataFrame, key: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Reduce ``df`` to the rows of the given distinct text keys, if those are small enough to broadcast.

    ``keys`` is a staged table; its bytes are summed first. Beyond the bound ``df``
    comes back as it is; the caller's own join drops the other rows then.
    """
    size = keys.agg(F.coalesce(F.sum(F.octet_length(key) + ROW_BYTES), F.lit(0))).first()[0]
    if size > most_bytes:
        return df
    return df.join(F.broadcast(keys), key, "left_semi")
