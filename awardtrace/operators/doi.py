"""Joins of a funder's list with the corpus on DOI."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardtrace.functions.names import all_quoted
from awardtrace.operators.clean import funder_grants, group_by
from awardtrace.operators.joins import anti_join_spreading_nulls, keep_if_small_keys, skew_join
from awardtrace.operators.pairs import DEFAULT_TIERS, score_pairs
from awardtrace.sources.tables import stage

# All operators take one funder, or None for all at once: then the list has a ``funder`` column too, rows meet on
# (funder, DOI), and the results begin with the funder.


def _sides(cleaned: DataFrame, grants: DataFrame, funder: str | None, emit_missing: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of both sides that may meet."""
    left = cleaned.dropna(subset=[*group_by(funder), "doi"])
    right = funder_grants(grants, funder).filter(F.col("doi").isNotNull())
    if not emit_missing:
        left = left.filter(F.col("award_id").isNotNull())
        right = right.filter(F.col("award_id").isNotNull())
    return left.distinct(), right.withColumnRenamed("award_id", "corpus_award_id")


def largest_products(cleaned: DataFrame, grants: DataFrame, funder: str | None, k: int = 10) -> DataFrame:
    """(doi, pairs): the DOIs with most pairs of input row and assertion, to look at before the join.

    A placeholder DOI with many rows on both sides makes the result grow with their product.
    """
    on = [*group_by(funder), "doi"]
    left, right = _sides(cleaned, grants, funder, emit_missing=True)
    left = left.groupBy(*on).agg(F.count("*").alias("left_rows"))
    right = right.groupBy(*on).agg(F.count("*").alias("right_rows"))
    pairs = left.join(right, on).select(*on, (F.col("left_rows") * F.col("right_rows")).alias("pairs"))
    return pairs.orderBy(F.desc("pairs"), *on).limit(k)


def join_on_doi(cleaned: DataFrame, assertions: DataFrame, on: list[str]) -> DataFrame:
    """Every input row with each distinct award id that the corpus has under its DOI.

    The works behind an award id are left out here, so a placeholder DOI with many rows
    on both sides costs its input rows times its ids, not times its assertions. Both
    sides are made distinct before they meet; copies are merged on the map side, and a
    DOI that stays hot is split by the skew join of AQE.
    """
    return cleaned.join(assertions.select(*on, "corpus_award_id").distinct(), on)


def _expanded(judged: DataFrame, assertions: DataFrame, on: list[str]) -> DataFrame:
    """The rows once for each work that the corpus has under their DOI and award id."""
    keys = [*on, "corpus_award_id"]
    works = assertions.select("work_id", *[F.col(c).alias(f"_right_key_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_right_key_{c}")) for c in keys]
    return judged.join(works, same).drop(*[f"_right_key_{c}" for c in keys])


def compare_on_doi(
    cleaned: DataFrame,
    grants: DataFrame,
    funder: str | None,
    tiers=DEFAULT_TIERS,
    with_score: bool = True,
    emit_missing: bool = False,
) -> DataFrame:
    """Input rows and assertions on one DOI with ``match_type``, ``is_match`` and the score, for both results.

    Each table is read once: the assertions of the funder and the joined rows are written
    to the staging folder when this is called. Distinct pairs of ids are compared, each
    once, their verdicts joined to the rows, and these expanded to works at the end. A row
    with a null award id on either side has no verdict and is left out; ``emit_missing``
    keeps it, labelled ``missing``.
    """
    on = [*group_by(funder), "doi"]
    left, right = _sides(cleaned, grants, funder, emit_missing)
    right = stage(right, "assertions")
    joined = stage(join_on_doi(left, right, on), "doi-join")
    pairs = joined.select("award_id", "corpus_award_id").dropna().distinct()
    verdicts = score_pairs(pairs, "award_id", "corpus_award_id", tiers, with_score)
    scored = skew_join(joined, verdicts, ["award_id", "corpus_award_id"], "left")
    verdict = [c for c in scored.columns if c not in joined.columns]
    scored = _expanded(scored, right, on).select(*all_quoted(joined.columns), "work_id", *verdict)
    if emit_missing:
        both_null = F.col("award_id").isNull() & F.col("corpus_award_id").isNull()
        missing = F.col("is_match").isNull()
        if with_score:
            scored = scored.withColumn(
                "similarity_score",
                F.when(missing, F.when(both_null, 1.0).otherwise(0.0)).otherwise(F.col("similarity_score")),
            )
        scored = scored.withColumn("match_type", F.when(missing, "missing").otherwise(F.col("match_type")))
        scored = scored.withColumn("is_match", F.coalesce("is_match", F.lit(False)))
    scored = scored.withColumn("match_type", F.coalesce("match_type", F.lit("no_match")))
    if with_score:
        scored = scored.withColumn("similarity_score", F.round("similarity_score", 3))
    return scored.withColumn("funder_award_id", F.col("award_id"))


def _result(compared: DataFrame, drop: list[str]) -> DataFrame:
    last = ["funder_award_id", "corpus_award_id", "work_id", "match_type", "similarity_score"]
    last = [c for c in last if c in compared.columns]
    first = [c for c in compared.columns if c not in last and c not in drop]
    return compared.select(*all_quoted(first), *last)


def matched(compared: DataFrame) -> DataFrame:
    """Same DOI, matching award id."""
    return _result(compared.filter("is_match"), ["is_match", "award_id"])


def award_differs(compared: DataFrame) -> DataFrame:
    """Same DOI, other award id."""
    return _result(compared.filter("NOT is_match"), ["is_match"])


def doi_profile(grants: DataFrame, funder: str) -> DataFrame:
    """Per DOI of the whole corpus: one work, and whether the funder is acknowledged.

    Both are merged on the map side: a DOI costs one row per map task at most.
    """
    return (
        grants.filter(F.col("doi").isNotNull())
        .groupBy("doi")
        .agg(
            F.min("work_id").alias("work_id"),
            F.coalesce(F.bool_or(F.col("funder") == funder), F.lit(False)).alias("acknowledged"),
        )
    )


def absent_from_corpus(cleaned: DataFrame, grants: DataFrame, funder: str | None) -> DataFrame:
    """Input rows whose DOI has no assertion of this funder, with a work known under that DOI if any.

    The corpus is reduced to the DOIs of the input before it is shuffled, if these are
    few; they are written and measured when this is called.
    """
    rows = cleaned.filter(F.col("doi").isNotNull())
    relevant = keep_if_small_keys(grants, stage(input_dois(cleaned), "input_dois"), "doi")
    if funder is not None:
        # A DOI has one profile, so copies may merge behind the join, where the acknowledged rows are gone.
        found = skew_join(rows, doi_profile(relevant, funder), ["doi"], "left")
        absent = found.filter(~F.coalesce("acknowledged", F.lit(False)))
        return absent.select(*all_quoted(cleaned.columns), "work_id").distinct()
    known = relevant.filter(F.col("doi").isNotNull())
    acknowledged = known.select("funder", "doi").dropna().distinct()
    works = known.groupBy("doi").agg(F.min("work_id").alias("work_id"))
    absent = skew_join(rows.dropna(subset=["funder"]).distinct(), acknowledged, ["funder", "doi"], "left_anti")
    return skew_join(absent, works, ["doi"], "left").select(*all_quoted(cleaned.columns), "work_id")


def input_dois(cleaned: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return cleaned.select(*by, "doi").dropna().distinct()


def dois_not_in_input(cleaned: DataFrame, grants: DataFrame, funder: str) -> DataFrame:
    """Distinct DOIs of the funder that the input lacks; a null DOI counts as one of them."""
    dois = grants.filter(F.col("funder") == funder).select("doi").distinct()
    return dois.join(input_dois(cleaned), "doi", "left_anti")


def unmatched_by_doi(cleaned: DataFrame, grants: DataFrame, funder: str | None) -> DataFrame:
    """The funder's (work, DOI, award) rows whose DOI is null or not in the input."""
    by = group_by(funder)
    rows, dois = funder_grants(grants, funder), input_dois(cleaned, by)
    if not by:
        return anti_join_spreading_nulls(rows, dois, "doi", spread_by=["work_id", "award_id"])
    key = F.concat_ws("\x00", "funder", "doi")  # one text key, null with the DOI
    rows = rows.withColumn("_place_key", F.when(F.col("doi").isNotNull(), key))
    dois = dois.select(key.alias("_place_key"))
    return anti_join_spreading_nulls(rows, dois, "_place_key", spread_by=["work_id", "award_id"]).drop("_place_key")
