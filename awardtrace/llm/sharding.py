"""Sharding by histogram sort.

Rows are ordered by a key (hash of the text, then hash of the id). Histograms count
the exact bytes below probes on that key; ranges that are still above the tolerance
get finer probes, until every range is small or cannot be told apart further. All
splitters then lie in known ranges with known sums below them, and one exchange by
range gives each row its exact place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, hash_bits, quoted, stage, text_or_empty

SHARDS = 40
ROW_BYTES = 16
#: A range is refined while it has more than this part of a shard.
TOLERANCE = 64
#: The key has TEXT_BITS of the text's hash and ID_BITS of the id's. Probes are refined by these leading bits.
TEXT_BITS, ID_BITS = 32, 28
LEVELS = (12, 22, 32, 46, 60)


def _prefix(level: int) -> Column:
    return F.shiftright("_at", TEXT_BITS + ID_BITS - LEVELS[level])


def _ranges(rows: DataFrame, tolerance: Column | int) -> tuple[DataFrame, list[DataFrame]]:
    """Leaf ranges with their sums, and the refined ranges of each level.

    A refined range has more bytes than the tolerance, so a level has at most
    shards * TOLERANCE of them, whatever the size of the input: they may be broadcast.
    """
    leaves, refined, inside = None, [], rows
    for level, bits in enumerate(LEVELS):
        last = level == len(LEVELS) - 1
        sums = inside.groupBy(_prefix(level).alias("_prefix")).agg(
            F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        sums = stage(sums.withColumn("_level", F.lit(level)), "shard-histogram")
        large = (F.col("_bytes") > tolerance) & (F.col("_rows") > 1) & (not last)
        small = sums.where(~large)
        leaves = small if leaves is None else leaves.unionByName(small)
        hot = sums.where(large).select("_prefix")
        if last or hot.isEmpty():
            break
        refined.append(hot)
        inside = inside.withColumn("_prefix", _prefix(level)).join(F.broadcast(hot), "_prefix", "left_semi").drop("_prefix")
    return leaves, refined


def placed(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row of ``docs``.

    Shards are near equal in bytes; the size of a row is the UTF-8 bytes of its text
    (null: none) plus 16. Equal texts stand together in the order and share a shard,
    unless the group is larger than 1/64 of a shard, which is then split where the
    bytes say. ``slot`` counts from 0 in each shard without gaps. Rows that are equal in
    text and key are interchangeable. A very long text is one row, so shards may differ
    by its size. An empty table gives no rows. One task orders the leaf ranges: at most some
    ``shards * TOLERANCE`` times 1,024 of them a level, whatever the size of the input.
    """
    body = text_or_empty(text)
    rows = docs.select(
        quoted(key).alias("_key"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        (F.shiftleft(hash_bits(body, TEXT_BITS), ID_BITS)
         + hash_bits(F.coalesce(quoted(key).cast("string"), F.lit("")), ID_BITS)).alias("_at"))
    rows = stage(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    tolerance = total // (shards * TOLERANCE)
    leaves, refined = _ranges(rows.select("size", "_at"), tolerance)
    shift = F.element_at(F.array(*[F.lit(1 << (TEXT_BITS + ID_BITS - b)) for b in LEVELS]), F.col("_level") + 1)
    before = Window.orderBy(F.col("_prefix") * shift).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(leaves.select(
        "_level", "_prefix", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before")), "shard-ranges")
    level = F.lit(0)
    for depth, hot in enumerate(refined):
        name = f"_hot{depth}"
        rows = rows.withColumn(name, _prefix(depth)).join(
            F.broadcast(hot.select(F.col("_prefix").alias(name), F.lit(True).alias(f"_is{depth}"))), name, "left")
        level = F.when(F.col(f"_is{depth}"), F.lit(depth + 1)).otherwise(level)
    by_level = F.element_at(F.array(*[_prefix(i) for i in range(len(LEVELS))]), F.col("_level") + 1)
    ranged = rows.withColumn("_level", level).withColumn("_prefix", by_level)
    ranged = ranged.select("_key", "size", "text_crc32", "_at", "_level", "_prefix").join(offsets, ["_level", "_prefix"])
    leaf = ["_level", "_prefix"]
    order = Window.partitionBy(*leaf).orderBy("_at", F.col("_key").asc_nulls_last())
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_text = F.shiftright("_at", ID_BITS)
    counted = ranged.withColumn("_below", F.col("_bytes_before") + F.sum("size").over(up_to) - F.col("size")).withColumn(
        "_rank", F.col("_rows_before") + F.row_number().over(order) - 1)
    of_text = F.min("_below").over(Window.partitionBy(*leaf, own_text))
    # Beyond the level that ends with the text's bits the range is one large group of equal texts.
    at = F.when(F.col("_level") > LEVELS.index(TEXT_BITS), F.col("_below")).otherwise(of_text)
    shard = F.least(F.lit(shards - 1), F.floor(at * shards / max(total, 1))).cast("int")
    counted = stage(counted.select(F.col("_key").alias(key), "size", "text_crc32", shard.alias("shard"), "_rank"), "shard-ranks")
    first = counted.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return counted.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def op9_sharding(spark, sf_dir):
    return placed(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# The recursive part is the table of CRC-32 by byte.
OP9_SQL = r"""
WITH RECURSIVE bits(b, v, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE n = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
         ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS t,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS i
  FROM documents, crc),
b AS (
  SELECT *, sum(size) OVER (ORDER BY t, i, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below,
         row_number() OVER (ORDER BY t, i, doc_id NULLS LAST) - 1 AS place,
         sum(size) OVER (PARTITION BY t) AS of_text, count(*) OVER (PARTITION BY t) AS copies, sum(size) OVER () AS total
  FROM d),
g AS (
  SELECT *, CASE WHEN copies > 1 AND of_text > total // 2560 THEN below ELSE min(below) OVER (PARTITION BY t) END AS start
  FROM b),
s AS (SELECT *, least(39, start * 40 // total)::INT AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM s
"""
