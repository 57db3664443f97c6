"""The queries: every operator, run over the whole of the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.functions import award as A
from awardtrace.functions.ratio import similarity_ratio
from awardtrace.operators import clean, doi, overlap, profiles
from awardtrace.operators.pairs import DEFAULT_TIERS, STRICT_TIERS, STRUCTURED_TIERS, score_pairs, with_pair_features
from awardtrace.plans import build, reconcile, report
from awardtrace.sources import csv, tables
from checks.adapter import FUNDER, all_lists, funder_list, grants, grants_raw, input_raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- sources and cleaning -------------------------------------------------------------------------


@query
def scan_grants_csv(spark, sf_dir):
    path = tables.staging_path(spark, "grants_csv")
    csv.write_csv(grants_raw(spark, sf_dir), path)
    return csv.scan_grants_csv(spark, path)


@query
def scan_input_csv(spark, sf_dir):
    path = tables.staging_path(spark, "input_csv")
    csv.write_csv(input_raw(spark, sf_dir), path)
    return csv.scan_input_csv(spark, path)


@query
def build_grants(spark, sf_dir):
    path = tables.staging_path(spark, "grants")
    tables.write_grants(clean.clean_grants(grants_raw(spark, sf_dir)), path)
    return tables.read_grants(spark, path)


@query
def build_over_existing(spark, sf_dir):
    """A table is refused while another one is there, and replaced if that is asked for."""
    path = tables.staging_path(spark, "grants")
    table = grants(spark, sf_dir)
    tables.write_ranges(table.filter(F.col("funder").isNull()), path)
    try:
        tables.write_ranges(table, path)
        refused = False
    except AnalysisException as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    before = tables.read_grants(spark, path).filter(F.col("funder").isNotNull()).count()
    tables.write_ranges(table, path, force=True)
    return tables.read_grants(spark, path).withColumn("refused", F.lit(refused and before == 0))


@query
def json_extract(spark, sf_dir):
    """Over both JSON columns there are: raw assertions and event properties."""
    raw = grants_raw(spark, sf_dir).select("work_id", "value")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("work_id"), F.col("props").alias("value")
    )
    return clean.extract_json(raw.unionByName(events)).select("work_id", "funder", "award_id")


@query
def clean_input_doi(spark, sf_dir):
    raw = input_raw(spark, sf_dir).select("doi").distinct()
    return raw.select(F.col("doi").alias("raw_doi"), clean.clean_doi(F.col("doi")).alias("doi"))


@query
def split_by_doi(spark, sf_dir):
    parts = clean.split_by_doi(funder_list(spark, sf_dir))
    marked = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("with_doi", "without_doi"))]
    return marked[0].unionByName(marked[1])


@query
def null_award_split(spark, sf_dir):
    parts = clean.split_by_award(clean.funder_grants(grants(spark, sf_dir), FUNDER))
    marked = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("with_award", "without_award"))]
    return marked[0].unionByName(marked[1])


@query
def funder_grants(spark, sf_dir):
    return clean.funder_grants(grants(spark, sf_dir), FUNDER)


@query
def distinct_awards(spark, sf_dir):
    return clean.distinct_awards(funder_list(spark, sf_dir))


@query
def build_metadata(spark, sf_dir):
    """The rows of counts; the others hold the time of the build."""
    metadata = profiles.build_metadata(grants(spark, sf_dir), sf_dir)
    return metadata.filter(F.col("key").isin("total_rows", "parsed_rows")).select("key", "value")


@query
def input_renamed(spark, sf_dir):
    """A list whose award column has another name."""
    raw = input_raw(spark, sf_dir).withColumnRenamed("award_id", "grant_no")
    return clean.clean_input(raw, award_field="grant_no")


@query
def database_info(spark, sf_dir):
    """Metadata and profile that a build leaves, as (section, key, value); times and paths left out."""
    folder = tables.staging_path(spark, "database")
    table = grants(spark, sf_dir)
    tables.write_grants(table, f"{folder}/grants")
    profiles.build_metadata(table, sf_dir).write.parquet(f"{folder}/metadata")
    metadata, profile, top = build.database_info(spark, folder)
    numbers = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in profile.columns])
    return (
        metadata.filter(F.col("key").isin("total_rows", "parsed_rows")).select(F.lit("metadata").alias("section"), "key", "value")
        .unionByName(profile.select(F.lit("profile").alias("section"), F.inline(numbers)))
        .unionByName(top.select(F.lit("funders").alias("section"), F.col("funder").alias("key"),
                                F.col("n").cast("string").alias("value")))
    )


@query
def quality_checks(spark, sf_dir):
    table = grants(spark, sf_dir)
    metadata = profiles.build_metadata(table, sf_dir)
    return profiles.quality_checks(clean.clean_and_flag(grants_raw(spark, sf_dir)), table, metadata)


# --- profiles -------------------------------------------------------------------------------------


@query
def table_profile(spark, sf_dir):
    return profiles.table_profile(grants(spark, sf_dir))


@query
def funder_profile(spark, sf_dir):
    return profiles.funder_profile(grants(spark, sf_dir), FUNDER)


@query
def funder_profile_all(spark, sf_dir):
    return profiles.funder_profile_all(grants(spark, sf_dir))


@query
def top_funders(spark, sf_dir):
    return profiles.top_funders(grants(spark, sf_dir), 10)


@query
def input_profile(spark, sf_dir):
    return profiles.input_profile(funder_list(spark, sf_dir))


# --- award ids and pairs of award ids -------------------------------------------------------------


def all_awards(spark, sf_dir) -> DataFrame:
    """Every distinct award id of both tables."""
    both = funder_list(spark, sf_dir).select("award_id").unionByName(grants(spark, sf_dir).select("award_id"))
    return both.dropna().distinct()


def pairs(spark, sf_dir) -> DataFrame:
    """Every distinct (input id, corpus id) on one DOI, all funders."""
    rows = funder_list(spark, sf_dir).select("doi", "award_id").dropna().distinct()
    corpus = grants(spark, sf_dir).select("doi", F.col("award_id").alias("id2")).dropna().distinct()
    return tables.stage(rows.withColumnRenamed("award_id", "id1").join(corpus, "doi").select("id1", "id2").distinct(), "pairs")


def featured_pairs(spark, sf_dir, *names: str) -> DataFrame:
    """The pairs with the features that a query compares."""
    return with_pair_features(pairs(spark, sf_dir), "id1", "id2", list(names))


def sides(feature: str):
    return F.col(A.LEFT + feature), F.col(A.RIGHT + feature)


@query
def award_normalize(spark, sf_dir):
    return all_awards(spark, sf_dir).withColumn("norm", A.normalize(F.col("award_id")))


@query
def award_segments(spark, sf_dir):
    """Segments joined by a bar, and how many are numbers."""
    segs = all_awards(spark, sf_dir).withColumn("segs", A.segments(F.col("award_id")))
    return segs.select("award_id", F.array_join("segs", "|").alias("segments"),
                       A.numeric_count(F.col("segs")).cast("long").alias("n_numeric"))


@query
def pair_exact(spark, sf_dir):
    left, right = sides("trimmed")
    return featured_pairs(spark, sf_dir, "trimmed").select("id1", "id2", (left == right).alias("is_exact"))


@query
def pair_substring(spark, sf_dir):
    (t1, t2), (n1, n2) = sides("trimmed"), sides("norm")
    return featured_pairs(spark, sf_dir, "trimmed", "norm").select("id1", "id2", A.substring_match(t1, n1, t2, n2).alias("is_substring"))


@query
def pair_normalized(spark, sf_dir):
    """The tier alone, since the tiers before it would take every pair."""
    typed = score_pairs(pairs(spark, sf_dir), "id1", "id2", ["normalized"], with_score=False)
    return typed.select("id1", "id2", "match_type")


@query
def segment_compat(spark, sf_dir):
    """Distinct segments that meet at one place of a pair."""
    segs = pairs(spark, sf_dir).select(A.segments(F.col("id1")).alias("a"), A.segments(F.col("id2")).alias("b"))
    met = segs.select(F.explode(F.arrays_zip("a", "b")).alias("m")).select("m.a", "m.b").dropna().distinct()
    structs = met.withColumns({"x": A.segment_struct(F.col("a")), "y": A.segment_struct(F.col("b"))})
    return structs.select(F.col("a").alias("segment1"), F.col("b").alias("segment2"),
                          A.segments_compatible(F.col("x"), F.col("y")).alias("compatible"))


@query
def structured_match(spark, sf_dir):
    left, right = sides("segs")
    df = featured_pairs(spark, sf_dir, "segs").withColumn("confidence", A.structured_confidence(left, right))
    return df.select("id1", "id2", A.structured_match(left, right, F.col("confidence")).alias("is_match"), "confidence")


@query
def pair_edit_distance(spark, sf_dir):
    left, right = sides("norm")
    return featured_pairs(spark, sf_dir, "norm").select("id1", "id2", F.levenshtein(left, right).cast("long").alias("distance"))


@query
def pair_lcs(spark, sf_dir):
    left, right = sides("norm")
    length = A.common_substring_length(left, right).cast("long")
    return featured_pairs(spark, sf_dir, "norm").select("id1", "id2", length.alias("lcs_length"))


@query
def overlap_coefficient(spark, sf_dir):
    left, right = sides("norm")
    return featured_pairs(spark, sf_dir, "norm").select("id1", "id2", A.overlap_coefficient(left, right).alias("coefficient"))


@query
def pair_ratio(spark, sf_dir):
    left, right = sides("norm")
    return featured_pairs(spark, sf_dir, "norm").select("id1", "id2", similarity_ratio(left, right).alias("ratio"))


@query
def pair_fuzzy(spark, sf_dir):
    """The fuzzy tier alone."""
    typed = score_pairs(pairs(spark, sf_dir), "id1", "id2", ["fuzzy"], with_score=False)
    return typed.select("id1", "id2", "match_type")


@query
def pair_match_type(spark, sf_dir):
    return score_pairs(pairs(spark, sf_dir), "id1", "id2", DEFAULT_TIERS, with_score=False)


@query
def pair_score(spark, sf_dir):
    scored = score_pairs(pairs(spark, sf_dir), "id1", "id2", tiers=())
    return scored.select("id1", "id2", F.round("similarity_score", 3).alias("similarity_score"))


# --- reconciliation -------------------------------------------------------------------------------


def sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, str]:
    return funder_list(spark, sf_dir), grants(spark, sf_dir), FUNDER


def compared(spark, sf_dir, tiers, with_score=False) -> DataFrame:
    return doi.compare_on_doi(*sources(spark, sf_dir), tiers, with_score)


@query
def matched_strict(spark, sf_dir):
    return doi.matched(compared(spark, sf_dir, STRICT_TIERS))


@query
def matched_structured(spark, sf_dir):
    return doi.matched(compared(spark, sf_dir, STRUCTURED_TIERS))


@query
def matched(spark, sf_dir):
    return doi.matched(compared(spark, sf_dir, DEFAULT_TIERS, with_score=True))


@query
def award_differs_strict(spark, sf_dir):
    return doi.award_differs(compared(spark, sf_dir, STRICT_TIERS))


@query
def award_differs(spark, sf_dir):
    return doi.award_differs(compared(spark, sf_dir, DEFAULT_TIERS, with_score=True))


@query
def award_differs_missing(spark, sf_dir):
    """Rows on one DOI of which one side has no award id."""
    rows = doi.compare_on_doi(*sources(spark, sf_dir), emit_missing=True)
    return doi.award_differs(rows).filter("match_type = 'missing'")


@query
def largest_products(spark, sf_dir):
    return doi.largest_products(*sources(spark, sf_dir), k=10)


@query
def absent_from_corpus(spark, sf_dir):
    return doi.absent_from_corpus(*sources(spark, sf_dir))


@query
def dois_not_in_input(spark, sf_dir):
    return doi.dois_not_in_input(*sources(spark, sf_dir))


def both_award_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Distinct ids of corpus rows whose DOI the input lacks, and of the input."""
    rows = doi.unmatched_by_doi(*sources(spark, sf_dir))
    return clean.distinct_awards(rows), clean.distinct_awards(funder_list(spark, sf_dir))


@query
def candidate_pairs(spark, sf_dir):
    """How many candidate pairs each shared segment stands for."""
    return overlap.block_sizes(*both_award_lists(spark, sf_dir))


@query
def best_overlap_match(spark, sf_dir):
    return overlap.best_overlap(*both_award_lists(spark, sf_dir))


@query
def award_overlap(spark, sf_dir):
    return reconcile.award_overlap(*both_award_lists(spark, sf_dir), with_score=True)


@query
def corpus_only(spark, sf_dir):
    return reconcile.corpus_only(*sources(spark, sf_dir))


# --- reports --------------------------------------------------------------------------------------


def results(spark, sf_dir) -> DataFrame:
    """Consolidated results, written first as in a real run, since several reports read them."""
    path = tables.staging_path(spark, "results")
    table = reconcile.consolidated(*sources(spark, sf_dir))
    tables.write_by_category(table, path)
    return spark.read.schema(table.schema).parquet(path)


def full_summary(spark, sf_dir) -> DataFrame:
    return report.summary(*sources(spark, sf_dir), results(spark, sf_dir))


@query
def consolidated_report(spark, sf_dir):
    return results(spark, sf_dir)


@query
def result_files(spark, sf_dir):
    """Rows of each result, counted in the files that were written."""
    folder = tables.staging_path(spark, "files")
    parts = reconcile.by_category(results(spark, sf_dir), funder_list(spark, sf_dir).columns)
    written = tables.write_result_files(parts, folder)
    counts = [csv.scan_csv(spark, f"{folder}/{name}", multi_line=False).agg(F.count("*").alias("rows"))
              .select(F.lit(name).alias("name"), "rows") for name in written]
    return functools.reduce(DataFrame.unionByName, counts)


@query
def result_counts(spark, sf_dir):
    return report.result_counts(reconcile.consolidated(*sources(spark, sf_dir)))


@query
def match_type_breakdown(spark, sf_dir):
    return report.match_type_breakdown(doi.matched(compared(spark, sf_dir, DEFAULT_TIERS)))


@query
def overlap_breakdown(spark, sf_dir):
    return report.overlap_breakdown(reconcile.corpus_only(*sources(spark, sf_dir), with_score=False))


@query
def overlap_from_no_doi(spark, sf_dir):
    only = reconcile.corpus_only(*sources(spark, sf_dir), with_score=False)
    return report.overlap_from_no_doi(only, funder_list(spark, sf_dir))


@query
def recon_stats(spark, sf_dir):
    return report.statistics(full_summary(spark, sf_dir))


@query
def recon_percentages(spark, sf_dir):
    return report.percentages(full_summary(spark, sf_dir))


@query
def report_lines(spark, sf_dir):
    return report.report_lines(full_summary(spark, sf_dir), FUNDER, "input", dated=False)


@query
def report_sheet(spark, sf_dir):
    return report.sheet(full_summary(spark, sf_dir), FUNDER, "input", dated=False)


# --- all funders in one job -----------------------------------------------------------------------


def all_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, None]:
    return all_lists(spark, sf_dir), grants(spark, sf_dir), None


@query
def matched_all(spark, sf_dir):
    return doi.matched(doi.compare_on_doi(*all_sources(spark, sf_dir)))


@query
def award_differs_all(spark, sf_dir):
    return doi.award_differs(doi.compare_on_doi(*all_sources(spark, sf_dir), STRUCTURED_TIERS, with_score=False))


@query
def largest_products_all(spark, sf_dir):
    return doi.largest_products(*all_sources(spark, sf_dir), k=10)


@query
def absent_from_corpus_all(spark, sf_dir):
    return doi.absent_from_corpus(*all_sources(spark, sf_dir))


@query
def corpus_only_all(spark, sf_dir):
    return reconcile.corpus_only(*all_sources(spark, sf_dir), with_score=False)


@query
def recon_stats_all(spark, sf_dir):
    path = tables.staging_path(spark, "results")
    table = reconcile.consolidated(*all_sources(spark, sf_dir))
    tables.write_by_category(table, path)
    results = spark.read.schema(table.schema).parquet(path)
    return report.statistics(report.summary(*all_sources(spark, sf_dir), results))
