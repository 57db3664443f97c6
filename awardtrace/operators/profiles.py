"""Profiles and checks of the corpus table and of a funder's list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distinct(column: str, approx: bool):
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def table_profile(grants: DataFrame, approx: bool = False) -> DataFrame:
    """One row of totals over the whole corpus, in one pass."""
    return grants.agg(
        F.count("*").alias("total_records"),
        _distinct("doi", approx).alias("unique_dois"),
        _distinct("funder", approx).alias("unique_funders"),
        _distinct("award_id", approx).alias("unique_awards"),
        F.count("funder").alias("parsed_rows"),
    )


def _funder_measures(approx: bool):
    return [
        _distinct("doi", approx).alias("unique_dois"),
        _distinct("award_id", approx).alias("unique_awards"),
        F.count("*").alias("total_records"),
    ]


def funder_profile(grants: DataFrame, funder: str, approx: bool = False) -> DataFrame:
    return grants.filter(F.col("funder") == funder).agg(*_funder_measures(approx))


def funder_profile_all(grants: DataFrame, approx: bool = False) -> DataFrame:
    """The same for every funder in one job."""
    return grants.filter(F.col("funder").isNotNull()).groupBy("funder").agg(*_funder_measures(approx))


def top_funders(grants: DataFrame, k: int = 10) -> DataFrame:
    """The k funders with most rows; ties go to the smaller id."""
    counts = grants.filter(F.col("funder").isNotNull()).groupBy("funder").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "funder").limit(k)


def input_profile(cleaned: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return cleaned.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        F.count("doi").alias("records_with_doi"),
        F.count_if(F.col("doi").isNull()).alias("records_without_doi"),
        F.count_distinct("doi").alias("unique_dois"),
        F.count_distinct("award_id").alias("unique_award_ids"),
    )


def build_metadata(grants: DataFrame, source: str) -> DataFrame:
    """(key, value, created_at) of a build: source, row counts, date."""
    counts = grants.agg(F.count("*").alias("total"), F.count("funder").alias("parsed"))
    now = F.current_timestamp()
    rows = {
        "source_file": F.lit(source),
        "total_rows": F.col("total").cast("string"),
        "parsed_rows": F.col("parsed").cast("string"),
        "build_date": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rows.items()])
    return counts.select(F.inline(entries)).withColumn("created_at", now)


def _checks(one_row: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), observed.cast("long").alias("observed"))
        for name, (passed, observed) in checks.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def grants_checks(grants: DataFrame) -> DataFrame:
    """(check_name, passed, observed) for the cleaned corpus table."""
    seen = grants.agg(F.count("*").alias("n"), F.count("funder").alias("parsed"))
    n, parsed = F.col("n"), F.col("parsed")
    return _checks(seen, {"grants_not_empty": (n > 0, n), "some_funder_parsed": (parsed > 0, parsed)})


def json_checks(flagged: DataFrame) -> DataFrame:
    """Rows whose ``value`` is present but no JSON; they count as rows without funder and award."""
    return _checks(flagged.agg(F.count_if("malformed").alias("bad")), {"value_is_json": (F.col("bad") == 0, F.col("bad"))})


def metadata_checks(metadata: DataFrame) -> DataFrame:
    """Keys of the metadata table must be unique."""
    seen = metadata.agg((F.count("*") - F.count_distinct("key")).alias("extra"))
    return _checks(seen, {"metadata_keys_unique": (F.col("extra") == 0, F.col("extra"))})


def quality_checks(flagged: DataFrame, grants: DataFrame, metadata: DataFrame) -> DataFrame:
    """All checks of a build; ``flagged`` comes from ``clean_and_flag``."""
    return grants_checks(grants).unionByName(json_checks(flagged)).unionByName(metadata_checks(metadata))
