"""Reconcile a funder's list with the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.functions.names import all_quoted
from awardtrace.operators import doi
from awardtrace.operators.clean import clean_input, distinct_awards, group_by
from awardtrace.operators.joins import left_join_spreading_nulls
from awardtrace.operators.overlap import best_overlap
from awardtrace.operators.pairs import DEFAULT_TIERS, score_pairs
from awardtrace.plans import report
from awardtrace.sources.csv import scan_input_csv
from awardtrace.sources.tables import stage, staging, write_by_category, write_input, write_result_files

CATEGORIES = ("matched", "award_differs", "absent_from_corpus", "corpus_only")


def award_overlap(
    corpus_awards: DataFrame, input_awards: DataFrame, with_score: bool = True, by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Per corpus award id found in the input under any DOI: the best input id, type and score.

    Overlap means containment, so the type is ``exact`` or ``substring``. The score
    takes the corpus id first, as the ratio depends on the order.
    """
    best = best_overlap(corpus_awards, input_awards, by)
    kind = F.when(F.col("exact"), "exact").otherwise("substring")
    found = best.select(*by, "award_id", "matching_input_award_id", kind.alias("overlap_type"))
    columns = [*by, "award_id", "matching_input_award_id", F.col("overlap_type").alias("match_type")]
    if with_score:
        found = score_pairs(stage(found, "overlap-pairs"), "award_id", "matching_input_award_id", tiers=())
        columns.append(F.round("similarity_score", 3).alias("similarity_score"))
    return found.select(*columns)


def corpus_only(cleaned: DataFrame, grants: DataFrame, funder: str | None, with_score: bool = True) -> DataFrame:
    """The funder's assertions whose DOI the input lacks, and whether their award id occurs in it.

    The DOI anti-join comes first, so only the award ids that remain are compared. It runs
    once: its rows are written to the staging folder, for the ids and for the result.
    """
    by = group_by(funder)
    rows = stage(doi.unmatched_by_doi(cleaned, grants, funder), "unmatched")
    overlap = award_overlap(distinct_awards(rows, by), distinct_awards(cleaned, by), with_score, by)
    if by:
        key = lambda award: F.concat_ws("\x00", "funder", award)
        rows = rows.withColumn("_overlap_key", F.when(F.col("award_id").isNotNull(), key("award_id")))
        overlap = overlap.select(key("award_id").alias("_overlap_key"), *[c for c in overlap.columns if c not in ("funder", "award_id")])
    joined = left_join_spreading_nulls(rows, overlap, "_overlap_key" if by else "award_id", spread_by=["work_id", "doi"])
    flags = {
        "has_award_overlap": F.col("matching_input_award_id").isNotNull(),
        "has_no_award_id": F.when(F.col("award_id").isNull(), True),
    }
    last = ["match_type"] + (["similarity_score"] if with_score else [])
    return joined.withColumns(flags).select(
        *by, "work_id", "doi", "award_id", "matching_input_award_id", *flags, *last
    )


def reconcile(
    cleaned: DataFrame,
    grants: DataFrame,
    funder: str | None,
    tiers=DEFAULT_TIERS,
    with_score: bool = True,
    emit_missing: bool = False,
) -> dict[str, DataFrame]:
    """The four results by category, for one funder or (None) for all of them at once."""
    compared = doi.compare_on_doi(cleaned, grants, funder, tiers, with_score, emit_missing)
    return {
        "matched": doi.matched(compared),
        "award_differs": doi.award_differs(compared),
        "absent_from_corpus": doi.absent_from_corpus(cleaned, grants, funder),
        "corpus_only": corpus_only(cleaned, grants, funder, with_score),
    }


def consolidated(
    cleaned: DataFrame,
    grants: DataFrame,
    funder: str | None,
    tiers=DEFAULT_TIERS,
    with_score: bool = True,
    emit_missing: bool = False,
) -> DataFrame:
    """All four results as one table with a ``category`` column.

    Both results of the DOI join come from one pass over it: the verdict becomes
    the category.
    """
    compared = doi.compare_on_doi(cleaned, grants, funder, tiers, with_score, emit_missing)
    verdict = F.when(F.col("is_match"), "matched").otherwise("award_differs")
    on_doi = (
        compared.withColumn("category", verdict)
        .withColumn("award_id", F.when(~F.col("is_match"), F.col("award_id")))
        .drop("is_match")
    )
    absent = doi.absent_from_corpus(cleaned, grants, funder).withColumn("category", F.lit("absent_from_corpus"))
    only = corpus_only(cleaned, grants, funder, with_score).withColumn("category", F.lit("corpus_only"))
    return on_doi.unionByName(absent, allowMissingColumns=True).unionByName(only, allowMissingColumns=True)


def by_category(table: DataFrame, input_columns: list[str]) -> dict[str, DataFrame]:
    """Split a consolidated table into the four results, each with its own columns.

    Of a table for all funders ``input_columns`` has the ``funder``, and so has each result.
    """
    verdict = ["funder_award_id", "corpus_award_id", "work_id", "match_type", "similarity_score"]
    overlap = ["matching_input_award_id", "has_award_overlap", "has_no_award_id", "match_type", "similarity_score"]
    columns = {
        "matched": [c for c in input_columns if c != "award_id"] + verdict,
        "award_differs": input_columns + verdict,
        "absent_from_corpus": input_columns + ["work_id"],
        "corpus_only": [c for c in ("funder",) if c in input_columns] + ["work_id", "doi", "award_id"] + overlap,
    }
    return {
        name: table.filter(F.col("category") == name).select(*all_quoted([c for c in wanted if c in table.columns]))
        for name, wanted in columns.items()
    }


def run(
    spark: SparkSession,
    input_csv: str,
    grants: DataFrame,
    funder: str | None,
    folder: str,
    award_field: str = "award_id",
    tiers=DEFAULT_TIERS,
    emit_missing: bool = False,
    force: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Reconcile a CSV list and write everything below ``folder``; returns the statistics.

    Without a funder the list has a ``funder`` column and all of them are reconciled in
    one job. The cleaned list is written before it is joined several times, and the results
    before they are counted and exported, so nothing is computed twice and lost
    executors cost a stage at most; nothing staged is left behind. Folders: ``input``,
    ``products`` (the DOIs with most pairs, written before the join), ``results`` (by
    category), ``csv`` (a dataset per result with rows), ``summary``, ``stats``, ``sheet``,
    ``report``. A list without line breaks inside quotes is split over tasks with
    ``multi_line=False``.
    """
    mode = "overwrite" if force else "errorifexists"
    write_input(clean_input(scan_input_csv(spark, input_csv, multi_line), award_field), f"{folder}/input", force)
    cleaned = spark.read.parquet(f"{folder}/input")
    if funder is None and "funder" not in cleaned.columns:
        raise ValueError("a list for all funders needs a column 'funder'")

    with staging(spark):
        doi.largest_products(cleaned, grants, funder).write.mode(mode).parquet(f"{folder}/products")
        table = consolidated(cleaned, grants, funder, tiers, emit_missing=emit_missing)
        write_by_category(table, f"{folder}/results", force)
        results = spark.read.schema(table.schema).parquet(f"{folder}/results")
        write_result_files(by_category(results, cleaned.columns), f"{folder}/csv", force)
        report.summary(cleaned, grants, funder, results).write.mode(mode).parquet(f"{folder}/summary")

    summary = spark.read.parquet(f"{folder}/summary")
    stats = report.statistics(summary)
    stats.write.option("header", True).mode(mode).csv(f"{folder}/stats")
    report.sheet(summary, funder, input_csv).write.option("header", True).mode(mode).csv(f"{folder}/sheet")
    lines = report.report_lines(summary, funder, input_csv).orderBy(*group_by(funder), "position")
    lines = lines.coalesce(1) if funder is not None else lines  # one funder's report is some fifty lines
    lines.select("line").write.mode(mode).text(f"{folder}/report")
    return stats
