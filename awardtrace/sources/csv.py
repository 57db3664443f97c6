"""CSV scans. Every column is read as text, under the name the header gives it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from awardtrace.operators.clean import RAW_COLUMNS, null_tokens


def scan_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Read CSV with a header and doubled quotes; a record with too few or too many fields is an error.

    So is a file whose header differs from that of the others: columns are never mixed.

    Without ``multi_line`` files are split over tasks, whatever their size. A line
    break inside quotes then shows as a broken record and fails the job, so rows
    are never silently torn; read such files with ``multi_line``, one task per file.
    """
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)  # compares every file's header with the schema
        # Field counts are checked on whole records only.
        .option("columnPruning", False)
        .csv(path)
    )


def _require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")


def scan_grants_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Corpus assertions; columns beyond the known eight are left out."""
    df = scan_csv(spark, path, multi_line)
    _require(df, RAW_COLUMNS, "corpus file")
    return df.select(*RAW_COLUMNS)


def scan_input_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A funder's list with any extra columns; "no value" tokens become null."""
    df = scan_csv(spark, path, multi_line)
    _require(df, ["doi"], "input file")
    return null_tokens(df)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV that ``scan_csv`` reads back unchanged."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode(mode)
        .csv(path)
    )
