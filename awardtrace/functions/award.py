"""Award-id features and comparison rules as native Column expressions.

An award id is compared through a few derived values, held in flat columns that
share a prefix (``with_features``). All rules below read those columns, so the
text work is done once per row of each side and a pair costs comparisons only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.functions.text import ascii_fold, strip

# Acceptance limits of the comparison rules.
STRUCTURED_MIN_CONFIDENCE = 0.75
STRUCTURED_MAX_LENGTH_GAP = 2
FUZZY_MIN_CONFIDENCE = 0.5
FUZZY_SHORT_ID = 3
FUZZY_MIN_RATIO_DIGITS = 0.95
FUZZY_MIN_RATIO = 0.90
NORMALIZED_SCORE = 0.95
CONTAINMENT_MIN_SCORE = 0.9
CAP_ABOVE_CONFIDENCE = 0.1

# Fixed value: what separates the segments of an id (ASCII by then).
SEPARATORS = r"[-_./\s\x1c-\x1f]+"

ALL_DIGITS = "^[0-9]+$"


def normalize(col: Column) -> Column:
    """ASCII letters and digits of an id in upper case; ``''`` for null."""
    return F.coalesce(F.upper(F.regexp_replace(ascii_fold(col), "[^A-Za-z0-9]", "")), F.lit(""))


def segments(col: Column) -> Column:
    """Upper-case parts of an id between separators; empty array for null."""
    parts = F.split(F.upper(ascii_fold(col)), SEPARATORS)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def is_numeric(segment: Column) -> Column:
    return segment.rlike(ALL_DIGITS)


def numeric_count(segs: Column) -> Column:
    return F.size(F.filter(segs, is_numeric))


def _without_zeros(digits: Column) -> Column:
    return F.ltrim(digits, F.lit("0"))


def segment_struct(segment: Column) -> Column:
    """A segment and whether it is a number."""
    return F.struct(segment.alias("text"), is_numeric(segment).alias("numeric"))


def _runs(text: Column) -> Column:
    """The numbers within a text, without leading zeros."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), _without_zeros)


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def _numbers_agree(x: Column, y: Column) -> Column:
    """Two all-digit segments: the same number, or a year in long and short form."""
    a, b = x["text"], y["text"]
    year = ((F.length(a) == 4) & (F.length(b) == 2) & a.endswith(b)) | (
        (F.length(b) == 4) & (F.length(a) == 2) & b.endswith(a)
    )
    return (_without_zeros(a) == _without_zeros(b)) | year


def segments_compatible(x: Column, y: Column) -> Column:
    """Whether two segments (``segment_struct``) may mean the same; first rule that fits decides.

    The numbers within a segment are looked up only where cheaper tests leave the case open.
    """
    a, b = x["text"], y["text"]
    runs_a, runs_b = _runs(a), _runs(b)
    shared = F.least(F.size(runs_a), F.size(runs_b))
    same_numbers = F.slice(runs_a, 1, shared) == F.slice(runs_b, 1, shared)
    return (
        F.when(a == b, True)
        .when(x["numeric"] & y["numeric"], _numbers_agree(x, y))
        .when(x["numeric"] | y["numeric"], False)
        .when((a.startswith(b) | b.startswith(a)) & (shared > 0) & same_numbers, True)
        .when(_letters(a) == _letters(b), (shared == 0) | (F.get(runs_a, 0) == F.get(runs_b, 0)))
        .otherwise(a.contains(b) | b.contains(a))
    )


def numeric_clash(x: Column, y: Column) -> Column:
    """Two all-digit segments that cannot mean the same."""
    return F.coalesce(x["numeric"] & y["numeric"] & ~_numbers_agree(x, y), F.lit(False))


FEATURES = ["trimmed", "norm", "segs", "n_numeric"]
LEFT, RIGHT = "_l_", "_r_"
FEATURE_COLUMNS = frozenset(side + name for side in (LEFT, RIGHT) for name in FEATURES)


def with_features(df: DataFrame, award: str, prefix: str) -> DataFrame:
    """Add ``{prefix}trimmed``, ``norm``, ``segs`` (``segment_struct`` each) and ``n_numeric``."""
    return (
        df.withColumns(
            {
                f"{prefix}trimmed": strip(F.col(award)),
                f"{prefix}norm": normalize(F.col(award)),
                f"{prefix}segs": F.transform(segments(F.col(award)), segment_struct),
            }
        )
        .withColumn(f"{prefix}n_numeric", F.size(F.filter(f"{prefix}segs", lambda s: s["numeric"])))
    )


def contained(a: Column, b: Column) -> Column:
    """Either text lies inside the other."""
    return a.contains(b) | b.contains(a)


def substring_match(trimmed1: Column, norm1: Column, trimmed2: Column, norm2: Column) -> Column:
    """Containment of the raw or of the normalised ids, either way round.

    Normalising works character by character, so raw containment implies
    normalised containment and only the latter has to be tested.
    """
    return (trimmed1 != "") & (trimmed2 != "") & contained(norm1, norm2)


def structured_confidence(segs1: Column, segs2: Column) -> Column:
    """Share of aligned segments that agree, over the longer id.

    Segments are compared position by position up to the shorter id. Numbers that
    clash in the first place, or in the last place of either id, settle the case:
    the share counts only what came before. The first place has nothing before
    it (0); a last place is always the end of the aligned part, so nothing that
    follows it would have been counted anyway.
    """
    n1, n2 = F.size(segs1), F.size(segs2)
    shared = F.least(n1, n2)
    agree = F.zip_with(F.slice(segs1, 1, shared), F.slice(segs2, 1, shared), segments_compatible)
    comparable = (shared > 0) & (F.abs(n1 - n2) <= STRUCTURED_MAX_LENGTH_GAP)
    return F.when(comparable & ~numeric_clash(F.get(segs1, 0), F.get(segs2, 0)),
                  F.size(F.filter(agree, lambda ok: ok)) / F.greatest(n1, n2)).otherwise(F.lit(0.0))


def structured_match(segs1: Column, segs2: Column, confidence: Column) -> Column:
    """High confidence and no clash of numbers at the end of the aligned part."""
    last = F.least(F.size(segs1), F.size(segs2)) - 1
    return (confidence >= STRUCTURED_MIN_CONFIDENCE) & ~numeric_clash(F.get(segs1, last), F.get(segs2, last))


def common_substring_length(a: Column, b: Column) -> Column:
    """Length of the longest text that lies in both.

    If a common text of some length exists, shorter ones do too, so the length is
    found by bisection: about log2(length) rounds of at most ``length`` lookups.
    """
    shortest = F.least(F.length(a), F.length(b))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(shortest + 1)).cast("int"))

    def halve(bounds: Column, _: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        middle = F.ceil((low + high) / 2).cast("int")
        starts = F.sequence(F.lit(1), F.length(a) - middle + 1)
        found = F.exists(starts, lambda i: b.contains(F.substring(a, i, middle)))
        narrowed = F.when(
            found, F.struct(middle.alias("low"), high.alias("high"))
        ).otherwise(F.struct(low.alias("low"), (middle - 1).alias("high")))
        return F.when(low < high, narrowed).otherwise(bounds)

    start = F.struct(F.lit(0).alias("low"), shortest.alias("high"))
    found = F.aggregate(rounds, start, halve, lambda bounds: bounds["low"])
    return F.when((a == "") | (b == ""), 0).otherwise(found)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct characters over the smaller set of distinct characters."""

    def characters(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))

    x, y = characters(a), characters(b)
    both = (a != "") & (b != "")
    share = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return F.when(both, share).otherwise(F.lit(0.0))

