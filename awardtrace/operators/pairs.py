"""Match type and similarity score of (left id, right id) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.functions import award as A
from awardtrace.functions.names import all_quoted
from awardtrace.functions.ratio import similarity_ratio
from awardtrace.operators.joins import skew_join
from awardtrace.sources.tables import stage

# The tiers in the order they are tried; exact equality always comes first.
# "structured" is the part of "fuzzy" that needs no similarity ratio.
DEFAULT_TIERS = ("substring", "normalized", "fuzzy")
STRICT_TIERS = ("substring", "normalized")
STRUCTURED_TIERS = ("substring", "normalized", "structured")
KNOWN_TIERS = frozenset(DEFAULT_TIERS + STRUCTURED_TIERS)

_WORK = "_pair_"


def _col(name: str) -> Column:
    return F.col(_WORK + name)


def _fuzzy(l: str, r: str, with_ratio: bool) -> tuple[Column, Column]:
    """(verdict, undecided): the fuzzy rule, and whether only the ratio can tell."""
    n1, n2 = F.col(f"{l}norm"), F.col(f"{r}norm")
    structured_ids = (F.col(f"{l}n_numeric") >= 2) & (F.col(f"{r}n_numeric") >= 2)
    too_short = F.least(F.length(n1), F.length(n2)) <= A.FUZZY_SHORT_ID
    blank = (F.col(f"{l}trimmed") == "") | (F.col(f"{r}trimmed") == "")
    accepted = A.contained(n1, n2) | _col("structured")
    rejected = (_col("confidence") < A.FUZZY_MIN_CONFIDENCE) | structured_ids | too_short
    undecided = ~(blank | accepted | rejected)
    both_digits = n1.rlike("[0-9]") & n2.rlike("[0-9]")
    needed = F.when(both_digits, A.FUZZY_MIN_RATIO_DIGITS).otherwise(A.FUZZY_MIN_RATIO)
    by_ratio = (_col("ratio") >= needed) if with_ratio else F.lit(False)
    return F.when(blank, False).when(accepted, True).when(rejected, False).otherwise(by_ratio), undecided


def _match_type(l: str, r: str, tiers: tuple[str, ...]) -> Column:
    t1, t2 = F.col(f"{l}trimmed"), F.col(f"{r}trimmed")
    n1, n2 = F.col(f"{l}norm"), F.col(f"{r}norm")
    kind = F.when(t1 == t2, "exact")
    if "substring" in tiers:
        kind = kind.when(A.substring_match(t1, n1, t2, n2), "substring")
    if "normalized" in tiers:
        kind = kind.when((t1 != "") & (t2 != "") & (n1 == n2), "normalized")
    if "fuzzy" in tiers:
        kind = kind.when(_fuzzy(l, r, True)[0], "fuzzy")
    elif "structured" in tiers:
        kind = kind.when(_fuzzy(l, r, False)[0], "fuzzy")
    return kind


def _native_score(l: str, r: str) -> tuple[Column, Column]:
    """(settled, best): the score where a rule fixes it, else the best of the native measures."""
    n1, n2 = F.col(f"{l}norm"), F.col(f"{r}norm")
    len1, len2 = F.length(n1), F.length(n2)
    settled = (
        F.when(F.col(f"{l}trimmed") == F.col(f"{r}trimmed"), 1.0)
        .when(n1 == n2, A.NORMALIZED_SCORE)
        .when((F.col(f"{l}n_numeric") >= 2) & (F.col(f"{r}n_numeric") >= 2), _col("confidence"))
    )
    containment = F.when(
        A.contained(n1, n2),
        F.greatest(F.lit(A.CONTAINMENT_MIN_SCORE), F.least(len1, len2) / F.greatest(len1, len2, F.lit(1))),
    ).otherwise(0.0)
    edit = F.when((n1 != "") & (n2 != ""), 1.0 - F.levenshtein(n1, n2) / F.greatest(len1, len2)).otherwise(0.0)
    # The ratio counts at least the longest common text, so it is never below
    # that measure, save where difflib starts to ignore frequent characters.
    common = F.when(
        (n1 != "") & (len2 >= 200), A.common_substring_length(n1, n2) / ((len1 + len2) / 2)
    ).otherwise(0.0)
    return settled, F.greatest(containment, edit, common)


def with_pair_features(df: DataFrame, left: str, right: str, names: list[str] = A.FEATURES) -> DataFrame:
    """Add the named features of both ids (prefixes ``LEFT`` and ``RIGHT``), worked out once for each distinct id.

    The table of features is written to the staging folder when this is called. Where an id
    is null, so are its features.
    """
    ids = df.select(F.explode(F.array(left, right)).alias("_pair_id")).dropna().distinct()
    features = A.with_features(ids, "_pair_id", "_pair_")
    features = stage(features.select("_pair_id", *[f"_pair_{c}" for c in names]), "award-features")
    for award, prefix in ((left, A.LEFT), (right, A.RIGHT)):
        own = features.select(F.col("_pair_id").alias(award), *[F.col(f"_pair_{c}").alias(prefix + c) for c in names])
        df = skew_join(df, own, [award], "left")
    return df


def score_pairs(
    df: DataFrame,
    left: str,
    right: str,
    tiers: tuple[str, ...] | list[str] = DEFAULT_TIERS,
    with_score: bool = True,
) -> DataFrame:
    """Add ``match_type`` (null: no match), ``is_match`` and, if asked for, ``similarity_score``.

    ``df`` has the features of both ids (``with_pair_features``) or gets them here, so it
    is best written or cheap. Where an id is null the results are null. Native rules run
    first; the Python ratio sees only the pairs whose type or score it can still change,
    the others reach it as null. Where segments are compared the scored pairs are written
    to the staging folder, so nothing that is done with them later does it again.
    """
    unknown = set(tiers) - KNOWN_TIERS
    if unknown:
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    l, r = A.LEFT, A.RIGHT
    kept = [c for c in df.columns if c not in A.FEATURE_COLUMNS]
    fuzzy = "fuzzy" in tiers
    segmented = fuzzy or "structured" in tiers or with_score
    if f"{l}norm" not in df.columns:
        df = with_pair_features(df, left, right, A.FEATURES if segmented else ["trimmed", "norm"])

    if segmented:
        segs1, segs2 = F.col(f"{l}segs"), F.col(f"{r}segs")
        equal = F.col(f"{l}norm") == F.col(f"{r}norm")
        # Ids with equal text never get as far as the segment rules.
        df = df.withColumn(
            _WORK + "confidence",
            F.when(equal, 0.0).otherwise(A.structured_confidence(segs1, segs2)),
        ).withColumn(
            _WORK + "structured", A.structured_match(segs1, segs2, _col("confidence"))
        )
        if not (fuzzy or with_score):
            # The verdict names the confidence many times; without a Python stage between, each would work it out.
            df = stage(df, "pair-confidences")

    need_ratio = F.lit(False)
    if with_score:
        settled, best = _native_score(l, r)
        df = df.withColumn(_WORK + "settled", settled)
        df = df.withColumn(_WORK + "best", F.when(_col("settled").isNull(), best))
        len1, len2 = F.length(f"{l}norm"), F.length(f"{r}norm")
        # Two upper limits: the ratio itself, and the cap put on the final score.
        ratio_limit = 2.0 * F.least(len1, len2) / F.greatest(len1 + len2, F.lit(1))
        cap = F.when(_col("confidence") > 0, _col("confidence") + A.CAP_ABOVE_CONFIDENCE)
        limit = F.least(ratio_limit, cap)  # least() passes over a missing cap
        need_ratio = need_ratio | (_col("settled").isNull() & (_col("best") < limit))
    if fuzzy:
        need_ratio = need_ratio | (_fuzzy(l, r, True)[1] & (F.col(f"{l}trimmed") != F.col(f"{r}trimmed")))
    if fuzzy or with_score:
        df = df.withColumn(_WORK + "need", F.coalesce(need_ratio, F.lit(False)))
        df = df.withColumn(
            _WORK + "ratio",
            similarity_ratio(
                F.when(_col("need"), F.col(f"{l}norm")), F.when(_col("need"), F.col(f"{r}norm"))
            ),
        )

    known = F.col(left).isNotNull() & F.col(right).isNotNull()
    df = df.withColumn("match_type", F.when(known, _match_type(l, r, tuple(tiers))))
    df = df.withColumn("is_match", F.when(known, F.col("match_type").isNotNull()))
    added = ["match_type", "is_match"]
    if with_score:
        best = F.greatest(_col("best"), _col("ratio"))  # greatest() passes over a missing ratio
        df = df.withColumn(
            "similarity_score",
            F.when(known, F.coalesce(_col("settled"), F.when(cap.isNull(), best).otherwise(F.least(best, cap)))),
        )
        added.append("similarity_score")
    scored = df.select(*all_quoted(kept), *added)
    return stage(scored, "pair-scores") if fuzzy or with_score else scored
