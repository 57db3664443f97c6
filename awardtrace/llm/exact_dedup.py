"""Exact dedup by content sort.

Texts are dealt out by sampled splitters over the start of their normalised bytes
and sorted within each range, so equal texts stand next to one another; the window
then compares whole neighbouring texts to find where a group ends. Starts and texts
that repeat often in a sample are hot: rows with a hot start are dealt by their
whole text, rows of a hot text over salts, and the heads of those salts are merged at
the end. A text gets salts by its share of the sample and the number of partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import SPACES, documents, quoted, stage, text_or_empty

#: Rows drawn to find hot starts and texts, and the share of the sample that makes one hot. The sample decides which
#: task a row goes to, never what comes out.
SAMPLE_ROWS = 20_000
HOT_SHARE = 0.002
#: Salts of a hot text for each partition that its share of the rows would fill.
SALTS_A_PARTITION = 2
START = 48


def normalised(text: Column) -> Column:
    """The text without the characters space and U+0009 to U+000D."""
    return F.regexp_replace(text, f"[{SPACES}]+", "")


def _start(text: Column) -> Column:
    """The first characters of the normalised text, without normalising the rest."""
    head = F.regexp_extract(text, rf"^(?:[{SPACES}]*[^{SPACES}]){{0,{START}}}", 0)
    return F.regexp_replace(head, f"[{SPACES}]+", "")


def _sha(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _hot(texts: DataFrame) -> tuple[list[str], dict[str, float]]:
    """Hot starts, and hot texts by SHA-256 with their share of the sample: at most 1 / HOT_SHARE of each."""
    total = texts.count()
    drawn = texts.sample(fraction=min(1.0, SAMPLE_ROWS / max(total, 1)), seed=7)
    least = max(8, int(HOT_SHARE * min(total, SAMPLE_ROWS)))
    counts = (drawn.select(_start(F.col("_text")).alias("start"), _sha(F.col("_text")).alias("sha"))
              .groupBy("start", "sha").agg(F.count("*").alias("n")))
    by_start = counts.groupBy("start").agg(
        F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") >= least, F.struct("sha", "n"))).alias("texts"))
    rows = by_start.where(F.col("rows") >= least).collect()
    drawn_rows = max(1, min(total, SAMPLE_ROWS))
    return [r.start for r in rows], {t.sha: min(1.0, t.n / drawn_rows) for r in rows for t in r.texts}


def _salts(shares: dict[str, float], partitions: int) -> dict[str, int]:
    """How many salts each hot text gets: a salt is the smallest part that can go to another task."""
    return {sha: math.ceil(share * partitions * SALTS_A_PARTITION) for sha, share in shares.items()}


def sorted_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, with the group of each row's text.

    Adds ``keep_id`` (key of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256``; ``docs`` is nested under ``row``, so no name can clash. Of equal
    texts the row with the most code points stays, then the smallest key (null last);
    of rows equal in both, exactly one. A null text counts as empty, and all empty
    texts are one group; very long texts are compared whole. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       text_or_empty(text).alias("_text"), quoted(key).alias("_key"))
    starts, texts = _hot(rows.select("_text"))
    body = F.col("_text")
    salt = F.lit(0).cast("long")
    hot = F.lit(False)
    if starts:
        by_text = F.crc32(normalised(body))
        in_start = F.col("_start").isin(starts)
        if texts:
            partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            salts = _salts(texts, partitions)
            own = F.try_element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), _sha(body))
            # By place, not by key: rows may be alike in that too.
            spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), own).cast("long")
            by_text = F.coalesce(-1 - spread, by_text)
        salt = F.when(in_start, by_text).otherwise(salt)
        hot = F.col("_salt") < 0
    dealt = (rows.withColumn("_start", _start(body)).withColumn("_salt", salt)
             .repartitionByRange("_start", "_salt").withColumn("_norm", normalised(body))
             .withColumn("_chars", F.char_length(body)))
    group = Window.partitionBy("_start", "_salt", "_norm")
    best = group.orderBy(F.desc("_chars"), F.col("_key").asc_nulls_last())
    grouped = dealt.select(
        "row", "_key", "_salt", "_chars", F.sha2("_norm", 256).alias("text_sha256"),
        F.first("_key").over(best).alias("keep_id"), F.row_number().over(best).alias("_place"),
        F.count("*").over(group).alias("group_size"))
    result = ["row", "keep_id", "group_size", (F.col("_place") == 1).alias("kept"), "text_sha256"]
    if not texts:
        return grouped.select(*result)
    grouped = stage(grouped, "content-sort")
    order = F.struct(-F.col("_chars"), F.col("_key").isNull(), F.col("_key"), F.col("_salt"))
    merged = (grouped.where(hot & (F.col("_place") == 1)).groupBy("text_sha256")
              .agg(F.min(order).alias("_best"), F.sum("group_size").alias("_size")))
    # At most 1 / HOT_SHARE rows, so small at any size of the input; before it a row for each salt at most.
    joined = grouped.join(F.broadcast(merged), "text_sha256", "left")
    is_hot = F.col("_best").isNotNull()
    return joined.select(
        "row", F.when(is_hot, F.col("_best._key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("_size", "group_size").alias("group_size"),
        ((F.col("_place") == 1) & (~is_hot | (F.col("_salt") == F.col("_best._salt")))).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return sorted_copies(docs, text, key).where("kept").select("row.*")


def op7_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # The text itself is not needed behind the sort.
    return sorted_copies(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
