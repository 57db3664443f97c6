"""Shared by the operators: tables, word rules, staging, hashes that DuckDB can compute too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.sources.tables import drop, stage, staging

__all__ = ["SPACES", "WORD", "documents", "drop", "hash_bits", "lower_ascii", "quoted", "stage", "staging", "text_or_empty",
           "word_count"]

SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_bits(value: Column, bits: int) -> Column:
    """The first bits (a multiple of 4) of the value's MD5 as a long."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, bits // 4), 16, 10).cast("long")
