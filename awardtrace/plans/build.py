"""Build the corpus table from raw assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from awardtrace.operators import profiles
from awardtrace.operators.clean import clean_and_flag
from awardtrace.sources.csv import scan_grants_csv
from awardtrace.sources.tables import read_grants, read_metadata, stage, staging, write_ranges


def build_from_csv(
    spark: SparkSession, source: str, folder: str, force: bool = False, multi_line: bool = False
) -> DataFrame:
    """CSV to ``folder/grants``, ``folder/metadata`` and ``folder/checks``; returns the checks of the written tables.

    An existing table is an error unless ``force`` is given. The source is parsed
    once, into the staging folder: the range partitioning looks at its keys twice,
    and the checks count what was written. Nothing staged is left behind.
    """
    mode = "overwrite" if force else "errorifexists"
    with staging(spark):
        flagged = stage(clean_and_flag(scan_grants_csv(spark, source, multi_line)), "parsed")
        write_ranges(flagged.drop("malformed"), f"{folder}/grants", force)
        grants = read_grants(spark, f"{folder}/grants")
        profiles.build_metadata(grants, source).write.mode(mode).parquet(f"{folder}/metadata")
        metadata = spark.read.parquet(f"{folder}/metadata")
        profiles.quality_checks(flagged, grants, metadata).coalesce(1).write.mode(mode).parquet(f"{folder}/checks")
    return spark.read.parquet(f"{folder}/checks")


def describe(grants: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Profile of the table and its largest funders."""
    return profiles.table_profile(grants), profiles.top_funders(grants, k)


def database_info(spark: SparkSession, folder: str, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a build left in a folder: its metadata, the profile of the table and its largest funders."""
    return (read_metadata(spark, f"{folder}/metadata"), *describe(read_grants(spark, f"{folder}/grants"), k))
