"""Counts, percentages and report texts of a reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.operators.clean import group_by
from awardtrace.operators.profiles import funder_profile, funder_profile_all, input_profile

MATCH_TYPES = ("exact", "substring", "normalized", "fuzzy")

# Section, its title in the report, its metrics in order.
INPUT = ("input", "Input list", ["total_records", "records_with_doi", "records_without_doi", "unique_dois",
                                 "unique_award_ids"])
CORPUS = ("corpus", "Corpus, this funder", ["funder_unique_dois", "funder_unique_awards", "funder_total_mappings"])
RESULTS = ("results", "Results", ["matched", "award_differs", "absent_from_corpus", "corpus_only"])
MATCHES = ("match_types", "Match types", [f"{kind}_matches" for kind in MATCH_TYPES])
OVERLAP = ("overlap", "Award ids of corpus rows whose DOI the input lacks",
           ["total_not_matched_by_doi", "with_award_overlap", "truly_missing"])
OVERLAP_TYPES = ("overlap_types", "Overlap by match type", [f"overlap_{kind}" for kind in MATCH_TYPES])
PERCENTAGES = ("percentages", "Percentages of input rows with DOI",
               ["pct_work_and_award_matched", "pct_work_matched_award_differs", "pct_records_not_in_corpus"])
SECTIONS = [INPUT, CORPUS, RESULTS, MATCHES, OVERLAP, OVERLAP_TYPES, PERCENTAGES]


def _is(category: str) -> Column:
    return F.col("category") == category


def _type_counts(of: Column, prefix: str, suffix: str) -> list[Column]:
    return [F.count_if(of & (F.col("match_type") == k)).alias(f"{prefix}{k}{suffix}") for k in MATCH_TYPES]


def match_type_breakdown(matched: DataFrame) -> DataFrame:
    """One row: matched rows per type, zero where there is none."""
    return matched.agg(*_type_counts(F.lit(True), "", "_matches"))


def _overlap_counts(of: Column) -> list[Column]:
    overlap = of & F.coalesce("has_award_overlap", F.lit(False))
    return [
        F.count_if(of).alias("total_not_matched_by_doi"),
        F.count_if(overlap).alias("with_award_overlap"),
        (F.count_if(of) - F.count_if(overlap)).alias("truly_missing"),
        *_type_counts(overlap, "overlap_", ""),
    ]


def overlap_breakdown(corpus_only: DataFrame) -> DataFrame:
    """One row: corpus rows the input lacks, with and without overlap, overlap per type."""
    return corpus_only.agg(*_overlap_counts(F.lit(True)))


def overlap_from_no_doi(corpus_only: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: overlaps with an award id that input rows without DOI hold, and rows without award id."""
    no_doi = (
        cleaned.filter(F.col("doi").isNull())
        .select(F.col("award_id").alias("matching_input_award_id"))
        .dropna().distinct().withColumn("without_doi", F.lit(True))
    )
    # Rows are few kinds: count them per input id before they meet the other list.
    counted = corpus_only.groupBy("matching_input_award_id").agg(
        F.count_if("has_award_overlap").alias("overlaps"), F.count_if(F.col("award_id").isNull()).alias("no_award")
    )
    via = F.when(F.col("without_doi"), F.col("overlaps")).otherwise(0)
    return counted.join(no_doi, "matching_input_award_id", "left").agg(
        F.coalesce(F.sum(via), F.lit(0)).alias("overlap_from_no_doi"),
        F.coalesce(F.sum("no_award"), F.lit(0)).alias("rows_without_award_id"),
    )


def result_counts(consolidated: DataFrame) -> DataFrame:
    return consolidated.groupBy("category").agg(F.count("*").alias("n"))


def summary(cleaned: DataFrame, grants: DataFrame, funder: str | None, consolidated: DataFrame) -> DataFrame:
    """One row with every metric: three aggregates, each over its table once.

    For all funders a row for each one that the list or the corpus knows.
    """
    by = group_by(funder)
    profile = funder_profile(grants, funder) if funder is not None else funder_profile_all(grants)
    corpus = profile.select(
        *by,
        F.col("unique_dois").alias("funder_unique_dois"),
        F.col("unique_awards").alias("funder_unique_awards"),
        F.col("total_records").alias("funder_total_mappings"),
    )
    results = consolidated.groupBy(*by).agg(
        *[F.count_if(_is(c)).alias(c) for c in RESULTS[2]],
        *_type_counts(_is("matched"), "", "_matches"),
        *_overlap_counts(_is("corpus_only")),
    )
    listed = cleaned if funder is not None else cleaned.filter(F.col("funder").isNotNull())
    parts = input_profile(listed, by).unionByName(corpus, allowMissingColumns=True)
    parts = parts.unionByName(results, allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in parts.columns if c not in by]
    row = parts.groupBy(*by).agg(*counts)
    base = F.col("records_with_doi")
    shares = dict(zip(PERCENTAGES[2], ["matched", "award_differs", "absent_from_corpus"]))
    return row.withColumns({name: F.when(base > 0, 100.0 * F.col(n) / base) for name, n in shares.items()})


def _of_funder(summary: DataFrame) -> list[str]:
    return ["funder"] if "funder" in summary.columns else []


def statistics(summary: DataFrame) -> DataFrame:
    """(section, metric, value), one row per number; of all funders each row with its own."""
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                 F.col(metric).cast("double").alias("value"))
        for section, _, metrics in SECTIONS for metric in metrics
    ]
    return summary.select(*_of_funder(summary), F.inline(F.array(*rows)))


def percentages(summary: DataFrame) -> DataFrame:
    return summary.select(*_of_funder(summary), *PERCENTAGES[2])


def _shown(section: tuple) -> Column:
    """Sections about rows that do not exist are left out."""
    if section is MATCHES:
        return F.col("matched") > 0
    if section is OVERLAP:
        return F.col("corpus_only") > 0
    if section is OVERLAP_TYPES:
        return F.col("with_award_overlap") > 0
    if section is PERCENTAGES:
        return F.col("records_with_doi") > 0
    return F.lit(True)


def _text(section: tuple, metric: str) -> Column:
    if section is PERCENTAGES:
        return F.format_string("%.2f%%", F.col(metric))
    return F.format_number(F.col(metric), 0)


def _numbered(summary: DataFrame, rows: list[tuple[Column, Column]]) -> DataFrame:
    """The rows whose condition holds, with their place in the list as ``position``."""
    entries = [F.struct(F.lit(i).alias("position"), shown.alias("shown"), row.alias("row"))
               for i, (shown, row) in enumerate(rows)]
    by = _of_funder(summary)
    return summary.select(*by, F.inline(F.array(*entries))).filter("shown").select(*by, "position", "row.*")


def _head(funder: str | None, source: str) -> list[tuple[str, Column]]:
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return [("generated", now), ("input", F.lit(source)), ("funder", F.lit(funder) if funder is not None else F.col("funder"))]


def _no_doi_note() -> tuple[Column, Column]:
    count = F.format_number("records_without_doi", 0)
    note = F.concat(F.lit("Overlap includes "), count, F.lit(" input rows without DOI"))
    return (F.col("corpus_only") > 0) & (F.col("records_without_doi") > 0), note


def report_lines(summary: DataFrame, funder: str | None, source: str, dated: bool = True) -> DataFrame:
    """(position, line): the report as text."""

    def line(text: Column) -> Column:
        return F.struct(text.alias("line"))

    always = F.lit(True)
    rows = [(always, line(F.lit("RECONCILIATION REPORT")))]
    rows += [(always, line(F.concat(F.lit(f"{name}: "), value)))
             for name, value in _head(funder, source) if dated or name != "generated"]
    for section in SECTIONS:
        _, title, metrics = section
        rows.append((_shown(section), line(F.lit(f"{title}:"))))
        rows += [(_shown(section), line(F.concat(F.lit(f"  {m}: "), _text(section, m)))) for m in metrics]
        if section is OVERLAP_TYPES:
            shown, note = _no_doi_note()
            rows.append((shown, line(F.concat(F.lit("  "), note))))
    return _numbered(summary, rows)


def sheet(summary: DataFrame, funder: str | None, source: str, dated: bool = True) -> DataFrame:
    """(position, metric, value): the statistics sheet, labels in title case."""

    def cells(metric: Column, value: Column) -> Column:
        return F.struct(metric.alias("metric"), value.alias("value"))

    always, empty = F.lit(True), F.lit("")
    rows = [(always, cells(F.initcap(F.lit(name)), value))
            for name, value in _head(funder, source) if dated or name != "generated"]
    for section in SECTIONS:
        _, title, metrics = section
        rows.append((_shown(section), cells(F.upper(F.lit(title)), empty)))
        for metric in metrics:
            name = F.lit(metric.removeprefix("pct_").removeprefix("funder_").removeprefix("overlap_"))
            label = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
            rows.append((_shown(section), cells(label, _text(section, metric))))
        if section is OVERLAP_TYPES:
            shown, note = _no_doi_note()
            rows.append((shown, cells(F.lit("Note"), note)))
    return _numbered(summary, rows)
