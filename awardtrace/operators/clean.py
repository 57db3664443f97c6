"""Cleaning of corpus assertions and of a funder's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.functions.award import FEATURE_COLUMNS
from awardtrace.functions.names import quoted
from awardtrace.functions.text import blank_to_null, strip

RAW_COLUMNS = [
    "work_id", "doi", "field_name", "subfield_path", "value", "source_id", "doi_prefix", "source_file_path",
]
GRANT_COLUMNS = [
    "work_id", "doi", "field_name", "subfield_path", "funder", "award_id", "source_id", "doi_prefix",
    "source_file_path",
]

# Columns the reconciliation adds; an input column of that name would be ambiguous.
RESERVED_COLUMNS = frozenset(
    {"category", "work_id", "funder_award_id", "corpus_award_id", "match_type", "is_match", "similarity_score",
     "matching_input_award_id", "has_award_overlap", "has_no_award_id"}
) | FEATURE_COLUMNS
# How the names of columns begin that exist within an operator only.
INTERNAL = ("_pair_", "_key_hash", "_left_key", "_right_key", "_place", "_overlap_")


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _mark(value: Column) -> Column:
    """Stands behind a value to show that it ended where it should; no text holds its own hash."""
    return F.md5(value.cast("binary"))


def is_json(value: Column) -> Column:
    """Whether a text is exactly one JSON value; null for null.

    The value is parsed as the first of two elements of an array. Text behind it, a
    comma or a bracket too many, or single quotes leave other elements.
    """
    wrapped = F.concat(F.lit("["), value, F.lit(',"'), _mark(value), F.lit('"]'))
    parts = F.from_json(wrapped, "array<string>", _STRICT)
    sound = (F.size(parts) == 2) & F.coalesce(F.get(parts, F.lit(1)) == _mark(value), F.lit(False))
    return F.when(value.isNotNull(), F.coalesce(sound, F.lit(False)))


def extract_json(raw: DataFrame) -> DataFrame:
    """Add ``funder`` and ``award_id`` as text; null where absent or where ``value`` is no JSON.

    Of a repeated key the first one that is not null counts.
    """
    return _extracted(raw).drop("malformed")


def _extracted(raw: DataFrame) -> DataFrame:
    """The fields, and ``malformed`` where ``value`` is there but no JSON.

    One parse gives both fields of an object and, by a mark of its own in a second object,
    its soundness. What it does not settle is looked at again: other values, broken ones,
    and those that may repeat a key.
    """
    rest = [quoted(c) for c in raw.columns if c not in ("funder", "award_id")]
    value, fields = F.col("value"), F.col("_fields")
    wrapped = F.concat(F.lit("["), value, F.lit(',{"funder":"'), _mark(value), F.lit('"}]'))
    parsed = F.from_json(wrapped, "array<struct<funder:string,award_id:string>>", _STRICT)
    repeats = value.rlike(r'(?s)"(funder|award_id)".*"\1"') | value.contains("\\u")
    at_once = (F.size(fields) == 2) & (F.get(fields, F.lit(1))["funder"] == _mark(value)) & ~repeats
    rows = raw.select(*rest, parsed.alias("_fields"))
    rows = rows.withColumn("_at_once", F.coalesce(at_once, F.lit(False)))
    rows = rows.withColumn("_sound", F.when(F.col("_at_once"), True).otherwise(is_json(value)))

    def field(name: str) -> Column:
        alone = F.when(F.col("_sound"), F.get_json_object("value", f"$.{name}"))
        return F.when(F.col("_at_once"), F.get(fields, F.lit(0))[name]).otherwise(alone).alias(name)

    return rows.select(*rest, field("funder"), field("award_id"),
                       F.coalesce(~F.col("_sound"), F.lit(False)).alias("malformed"))


def clean_grants(raw: DataFrame) -> DataFrame:
    """Raw assertions to the nine ``grants`` columns."""
    return _clean(extract_json(raw)).select(*GRANT_COLUMNS)


def clean_and_flag(raw: DataFrame) -> DataFrame:
    """The same with a ``malformed`` column, to write and count without a second look at the source."""
    return _clean(_extracted(raw)).select(*GRANT_COLUMNS, "malformed")


def _clean(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("doi", F.lower(F.trim("doi")))


def clean_input(raw: DataFrame, award_field: str = "award_id") -> DataFrame:
    """A funder's list with a clean ``doi`` and an ``award_id`` column; other columns pass through."""
    if award_field != "award_id" and award_field in raw.columns:
        if "award_id" in raw.columns:
            raise ValueError(f"input has both {award_field!r} and 'award_id'")
        raw = raw.withColumnRenamed(award_field, "award_id")
    missing = {"doi", "award_id"} - set(raw.columns)
    if missing:
        raise ValueError(f"input lacks the columns {sorted(missing)}")
    clash = sorted(c for c in raw.columns if c.lower() in RESERVED_COLUMNS or c.lower().startswith(INTERNAL))
    if clash:
        raise ValueError(f"input columns would clash with result columns, rename them: {clash}")
    return raw.withColumn("doi", clean_doi(F.col("doi")))


def clean_doi(doi: Column) -> Column:
    """Literal ``nan`` is no DOI; else lower case, trimmed, and null when nothing is left."""
    text = strip(F.lower(F.when(doi != "nan", doi)))
    return F.when(text != "", text)


def null_tokens(raw: DataFrame) -> DataFrame:
    """Null for every cell that holds a "no value" token."""
    return raw.select(*[blank_to_null(quoted(c)).alias(c) for c in raw.columns])


def split_by_doi(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a DOI."""
    return cleaned.filter(F.col("doi").isNotNull()), cleaned.filter(F.col("doi").isNull())


def group_by(funder: str | None) -> list[str]:
    """What rows are told apart by besides their DOI: the funder, where a job serves all of them."""
    return [] if funder is not None else ["funder"]


def funder_grants(grants: DataFrame, funder: str | None) -> DataFrame:
    """Distinct (work, DOI, award) of one funder; the filter reaches the Parquet scan.

    Without a funder those of every one, with their ``funder``.
    """
    own = F.col("funder") == funder if funder is not None else F.col("funder").isNotNull()
    return grants.filter(own).select(*group_by(funder), "work_id", "doi", "award_id").distinct()


def split_by_award(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without an award id."""
    return rows.filter(F.col("award_id").isNotNull()), rows.filter(F.col("award_id").isNull())


def distinct_awards(rows: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*by, "award_id").dropna().distinct()
