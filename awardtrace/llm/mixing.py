"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. Sizes are summed by source and the hash's leading
bits; the bucket in which a source's running sum passes its budget is the only one
that is refined by further bits. The threshold found that way is a plain filter:
nothing is sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, hash_bits, quoted, stage, word_count
from awardtrace.operators.joins import skew_join

#: Bits of the hash, and how many of them each histogram looks at.
BITS = 36
STEP = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2

_SOURCE = "_mix_source"


def _source_key(source: Column) -> Column:
    """Never null, in the order of the sources by code point; null is told from any text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST_REPEATS) -> DataFrame:
    """Words to take of each source: ``_mix_source, source_size`` to those and ``target``.

    Sources in the order of code points, null last, get the weights in turn and share
    ``share`` of all sizes by weight. None gets more than ``most`` times its size; what
    is over goes to the others by weight. The window holds one row per source.
    """
    is_null = F.col(_SOURCE) == ""
    place = F.row_number().over(Window.orderBy(is_null, _SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * most)
    total = F.sum("source_size").over(Window.partitionBy())
    by_ratio = Window.orderBy(F.col("_most") / F.col("_weight"), is_null, _SOURCE)
    full_before = F.coalesce(F.sum("_most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total * F.lit(share) - full_before) / weight_left
    open_level = F.min(F.when(F.col("_most") > F.col("_level") * F.col("_weight"),
                              F.struct("_place", "_level"))).over(Window.partitionBy())["_level"]
    filled = ranked.withColumn("_level", level).withColumn("_place", F.row_number().over(by_ratio))
    target = F.least(F.col("_most").cast("double"), F.col("_weight") * F.coalesce(open_level, F.lit(float("inf"))))
    return filled.select(_SOURCE, "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash below which documents are taken once more than the others.

    ``sized`` has ``_mix_source, size, _hash``; ``budgets`` has ``_mix_source,
    source_size, target``. The threshold comes as near to the budget as whole hash
    values allow. Returns the budgets with ``_times`` (whole passes) and ``_below``.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = budgets.withColumn("_times", times.cast("long")).select(
        "*", (F.col("target") - F.col("_times") * F.col("source_size")).alias("_rest"),
        F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_sum"))
    state = stage(state, "mix-budgets")
    for used in range(STEP, BITS + 1, STEP):
        shift = BITS - used
        bucket = F.shiftright("_hash", shift)
        inside = skew_join(sized, state.select(_SOURCE, "_prefix", "_sum", "_rest"), [_SOURCE])
        inside = inside.where((F.shiftright("_hash", shift + STEP) == F.col("_prefix")) & (F.col("_rest") > 0))
        counts = inside.groupBy(_SOURCE, "_sum", "_rest", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"))
        running = Window.partitionBy(_SOURCE).orderBy("_bucket")  # at most 2 ** STEP rows of a source
        ends = counts.withColumn("_end", F.col("_sum") + F.sum("_size").over(running))
        # The first bucket that reaches the budget; it exists, as the budget is below the sum of the bucket above.
        edge = (ends.where(F.col("_end") >= F.col("_rest")).groupBy(_SOURCE)
                .agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_size")).alias("_before"), "_end")).alias("_edge")))
        state = state.join(edge, _SOURCE, "left").select(
            _SOURCE, "source_size", "target", "_times", "_rest",
            F.coalesce("_edge._bucket", F.lit(0).cast("long")).alias("_prefix"),
            F.coalesce("_edge._before", F.lit(0).cast("long")).alias("_sum"), F.col("_edge._end").alias("_end"))
        state = stage(state, "mix-histogram")
    nearer = (F.col("_end") - F.col("_rest")) <= (F.col("_rest") - F.col("_sum"))
    below = F.when(F.col("_end").isNull(), 0).otherwise(F.col("_prefix") + nearer.cast("long"))
    return stage(state.select(_SOURCE, "source_size", "target", "_times", below.alias("_below")), "mix-thresholds")


def _rules(docs: DataFrame, text: str, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The sized rows (``_key, _mix_source, size, _hash``), staged, and their thresholds."""
    sized = stage(docs.select(
        quoted(key).alias("_key"), _source_key(quoted(source)).alias(_SOURCE), word_count(quoted(text)).alias("size"),
        _hash(key)), "mix-sizes")
    budgets = targets(sized.groupBy(_SOURCE).agg(F.sum("size").alias("source_size")))
    return sized, thresholds(sized.select(_SOURCE, "size", "_hash"), budgets)


def _hash(key: str) -> Column:
    return hash_bits(F.coalesce(quoted(key).cast("string"), F.lit("")), BITS).alias("_hash")


def _repeats() -> Column:
    return F.col("_times") + (F.col("_hash") < F.col("_below")).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``key, size, source_size, target, repeats, taken`` for every row.

    The size of a row is its number of words (null text: 0). A row is taken
    ``repeats`` times; repeated keys have equal hashes and are taken alike, a null key
    hashes as empty text. A source without words gets a target of 0 and none of its
    rows. A very long text is one row that is taken or not, so a source comes as near to
    its target as whole rows let it. An empty table gives no rows. Some steps have a row
    per source in one task: meant for sources by the thousand, not for one per host.
    """
    sized, rules = _rules(docs, text, source, key)
    return skew_join(sized, rules, [_SOURCE]).select(
        F.col("_key").alias(key), "size", "source_size", "target", _repeats().alias("repeats"),
        (_repeats() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with its columns."""
    _, rules = _rules(docs, text, source, key)
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       _source_key(quoted(source)).alias(_SOURCE), _hash(key))
    taken = skew_join(rows, rules, [_SOURCE]).where(_repeats() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), _repeats().cast("int")))).select("row.*")


def op5_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir)).drop("repeats")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
sizes AS (
  SELECT s, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY s = '', s) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY s),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM sizes WINDOW o AS (ORDER BY 2 * source_size / w, s = '', s)),
targets AS (
  SELECT s, source_size,
         least((2 * source_size)::DOUBLE,
               w * coalesce((SELECT arg_min(lev, place) FROM levels WHERE 2 * source_size > lev * w), 'inf'::DOUBLE)) AS target
  FROM levels),
rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times,
         target - times * source_size AS rest
  FROM targets),
hashes AS (
  SELECT s, h, sum(size)::BIGINT AS b, sum(sum(size)) OVER (PARTITION BY s ORDER BY h) AS e FROM d GROUP BY s, h),
edge AS (
  SELECT s, arg_min(CASE WHEN e - rest <= rest - (e - b) THEN h + 1 ELSE h END, h) AS below
  FROM hashes JOIN rest USING (s) WHERE rest > 0 AND e >= rest GROUP BY s)
SELECT doc_id, size, source_size, target, size * (times + (h < coalesce(below, 0))::BIGINT) AS taken
FROM d JOIN rest USING (s) LEFT JOIN edge USING (s)
"""
