"""Award ids that reappear on the other side under another DOI.

Two ids are compared only if they share a whole segment that is worth an index
entry. They overlap if one normalised id lies inside the other. A segment such
as GRANT may occur in a third of all ids, so the pairs within a segment are never
formed. Instead the shorter id picks one of its grams, the one that is rarest on the
other side, and meets the ids that hold it; the longer id gives each of its grams
once. Ids shorter than a gram are met whole. So rows grow with the number of ids and
with their length, not with the square of either, and containment and the shared
segment are tested on what meets.

Each distinct id has a number, and a gram its hash, so the table of grams has two numbers
a row and is written once for both sides and both directions. (Grams of one hash only add
ids to compare.) Taking grams multiplies rows in a way Spark does not foresee when it
estimates sizes, so these are joined by sorting and merging, where AQE splits a very
common gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.functions.award import is_numeric, normalize, segments
from awardtrace.functions.text import strip
from awardtrace.operators.joins import skew_join
from awardtrace.sources.tables import stage


GRAM = 8


def indexed(segment: Column) -> Column:
    """Segments worth an index entry: all but numbers of one or two digits."""
    return (F.length(segment) > 2) | ~is_numeric(segment)


def segment_index(awards: DataFrame) -> DataFrame:
    """(award_id, norm, segment), one row per distinct indexed segment of a distinct id."""
    return (
        awards.select("award_id")
        .withColumn("norm", normalize(F.col("award_id")))  # before the ids are multiplied
        .withColumn("segment", F.explode(F.array_distinct(segments(F.col("award_id")))))
        .filter(indexed(F.col("segment")))
    )


def block_sizes(corpus_awards: DataFrame, input_awards: DataFrame) -> DataFrame:
    """Per shared segment the ids on both sides and the number of candidate pairs, none of which is formed."""
    corpus = segment_index(corpus_awards).groupBy("segment").agg(F.count("*").alias("corpus_awards"))
    funder = segment_index(input_awards).groupBy("segment").agg(F.count("*").alias("input_awards"))
    return corpus.join(funder, "segment").withColumn(
        "candidate_pairs", F.col("corpus_awards") * F.col("input_awards")
    )


def _with_segments(awards: DataFrame, by: list[str] | tuple[str, ...]) -> DataFrame:
    segs = F.array_sort(F.array_distinct(F.filter(segments(F.col("award_id")), indexed)))
    return awards.select(*by, "award_id", normalize(F.col("award_id")).alias("norm"), segs.alias("segs"))


def described(awards: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(award_id, norm, segs): distinct ids with their indexed segments in order; ids without any are left out."""
    return _with_segments(awards, by).filter(F.size("segs") > 0)


def _substrings(text: Column, length: Column | int) -> Column:
    """All pieces of that length."""
    places = F.char_length(text) - length + 1
    pieces = F.transform(F.sequence(F.lit(1), places), lambda i: F.substring(text, i, F.lit(length)))
    return F.when(places > 0, pieces).otherwise(F.array().cast("array<string>"))


def grams(ids: DataFrame, by: list[str]) -> DataFrame:
    """``side, id, total, gram``: one row for each distinct gram of each id, as a hash, and how many it has."""
    hashes = F.array_distinct(F.transform(_substrings(F.col("norm"), GRAM), lambda g: F.xxhash64(*by, g)))
    held = ids.select("side", "id", hashes.alias("grams"))
    return held.select("side", "id", F.size("grams").alias("total"), F.explode("grams").alias("gram"))


def _by_grams(held: DataFrame) -> DataFrame:
    """``side, id, other``: ids whose grams the other side has all, with the ids there that hold the rarest of them."""
    on = [F.count_if(F.col("side") == side).alias(f"on{side}") for side in (0, 1)]
    counts = held.groupBy("gram").agg(*on).filter("on0 > 0 AND on1 > 0")
    there = F.when(F.col("side") == 0, F.col("on1")).otherwise(F.col("on0"))
    shared = stage(skew_join(held, counts, ["gram"], merge=True).select("side", "id", "total", "gram", there.alias("n")),
                   "overlap-grams-shared")
    anchors = shared.groupBy("side", "id").agg(
        F.min(F.struct("n", "gram")).alias("rarest"), F.count("*").alias("found"), F.max("total").alias("total"))
    # An id of which the other side lacks a gram lies in none of its ids.
    anchors = anchors.filter("found = total").select("side", "id", "rarest.gram")
    others = shared.select((1 - F.col("side")).alias("side"), F.col("id").alias("other"), "gram")
    return skew_join(others, anchors, ["side", "gram"], merge=True).select("side", "id", "other")


def short_pieces(ids: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """``side, other, piece``: distinct pieces, of the given lengths for each side, of the ids of the other side.

    Of length 0 there are the segments without a letter or digit, as an id whose text is
    empty has no others to share.
    """
    none = F.array().cast("array<string>")
    of_side = []
    for side, wanted in lengths.items():
        pieces = [F.filter("segs", lambda x: ~x.rlike("[A-Z0-9]")) if n == 0 else _substrings(F.col("norm"), n) for n in wanted]
        of_side.append(F.when(F.col("side") == 1 - side, F.array_distinct(F.concat(none, *pieces))))
    held = ids.withColumn("piece", F.explode(F.coalesce(*of_side, none)))
    return held.withColumn("side", 1 - F.col("side")).withColumnRenamed("id", "other")


def _by_whole_text(ids: DataFrame, by: list[str]) -> DataFrame | None:
    """The same for ids shorter than a gram; None if there is none."""
    short = ids.filter(F.char_length("norm") < GRAM)
    found = short.select("side", F.char_length("norm").alias("n")).distinct().collect()  # a row per length and side
    if not found:
        return None
    lengths = {side: sorted(r.n for r in found if r.side == side) for side in {r.side for r in found}}
    whole = short.withColumn("piece", F.explode(F.when(F.col("norm") == "", F.col("segs")).otherwise(F.array("norm"))))
    on = ["side", *by, "piece"]
    pieces = short_pieces(ids, lengths).select(*on, "other")
    return skew_join(pieces, whole.select(*on, "id"), on, merge=True).select("side", "id", "other").distinct()


def best_overlap(corpus_awards: DataFrame, input_awards: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(award_id, matching_input_award_id, exact, length_gap): the best input id per corpus id that has one.

    Equal ids come first, then the smallest difference in normalised length, then
    the smallest input id. Ids meet only where the columns ``by``, which begin the result,
    are equal too. The ids of both sides and their grams are written to the staging folder
    when this is called.
    """
    by = list(by)
    text = strip(F.col("award_id")).alias("text")
    sides = [_with_segments(awards, by).withColumn("side", F.lit(side)) for side, awards in enumerate((corpus_awards, input_awards))]
    # Ids without an indexed segment go once the rows are written: a filter before would work the segments out twice.
    rows = stage(sides[0].unionByName(sides[1]), "overlap-rows").filter(F.size("segs") > 0)
    # Ids of equal normalised text and segments are one, under the smallest of them.
    ids = rows.groupBy("side", *by, "norm", "segs").agg(F.min("award_id").alias("match"))
    ids = stage(ids.withColumn("id", F.monotonically_increasing_id()), "overlap-ids")

    def candidate(not_exact: int, gap: Column, match: Column) -> Column:
        return F.struct(F.lit(not_exact).alias("not_exact"), gap.alias("gap"), match.alias("match"))

    # The same text on both sides; ids without an indexed segment are not compared at all.
    corpus, funder = (rows.filter(F.col("side") == side) for side in (0, 1))
    same = funder.groupBy(*by, text).agg(F.min("award_id").alias("match"))
    equal = skew_join(corpus.select(*by, "award_id", text), same, [*by, "text"]).select(
        *by, "award_id", candidate(0, F.lit(0), F.col("match")).alias("best"))

    met = _by_grams(stage(grams(ids, by), "overlap-grams"))
    by_text = _by_whole_text(ids, by)
    met = met if by_text is None else met.unionByName(by_text)
    own = ids.select("id", "norm", "segs")
    other = ids.select(F.col("id").alias("other"), F.col("norm").alias("long"), F.col("segs").alias("long_segs"))
    held = skew_join(skew_join(met, own, ["id"]), other, ["other"])
    holds = F.col("long").contains(F.col("norm")) & F.arrays_overlap("segs", "long_segs")
    of_corpus = F.col("side") == 0
    near = held.filter(holds).select(
        F.when(of_corpus, F.col("id")).otherwise(F.col("other")).alias("id"),
        F.when(of_corpus, F.col("other")).otherwise(F.col("id")).alias("input"),
        (F.char_length("long") - F.char_length("norm")).alias("gap"))
    matches = ids.filter("side = 1").select(F.col("id").alias("input"), "match")
    near = skew_join(near, matches, ["input"]).groupBy("id").agg(F.min(candidate(1, F.col("gap"), F.col("match"))).alias("best"))
    named = ids.filter("side = 0").select(*by, "norm", "segs", "id").join(near, "id").drop("id")
    within = skew_join(corpus.select(*by, "award_id", "norm", "segs"), named, [*by, "norm", "segs"]).select(*by, "award_id", "best")

    return (
        equal.unionByName(within)
        .groupBy(*by, "award_id").agg(F.min("best").alias("best"))
        .select(
            *by, "award_id",
            F.col("best.match").alias("matching_input_award_id"),
            (F.col("best.not_exact") == 0).alias("exact"),
            F.col("best.gap").alias("length_gap"),
        )
    )
