"""Text helpers as native Column expressions (no Python at run time)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dashes that count as a plain hyphen inside an award id
# (hyphen U+2010, en dash U+2013, em dash U+2014, minus sign U+2212).
DASHES = "‐–—−"

# The cell texts that a CSV reader of a funder's list takes for "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def whitespace() -> str:
    """Every character that ``str.strip()`` removes."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def strip(col: Column) -> Column:
    """Trim all Unicode whitespace on both ends."""
    return F.btrim(col, F.lit(whitespace()))


@lru_cache(maxsize=1)
def _ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """Non-ASCII characters whose compatibility decomposition (NFKD) holds ASCII,
    split into those giving one ASCII character and those giving several."""
    single, several = {}, {}
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(char):
            text = "".join(c for c in unicodedata.normalize("NFKD", char) if c.isascii())
            if text:
                (single if len(text) == 1 else several)[char] = text
    return single, several


def ascii_fold(col: Column) -> Column:
    """Dashes to hyphens, then NFKD, then drop what is not ASCII.

    Decomposing is done per character and never moves an ASCII character, so a
    character table gives the same text. Ids that are ASCII already, nearly all
    of them, take the short way: the other branches are not evaluated.
    """
    single, several = _ascii_parts()
    # One literal each way; a map built entry by entry would swell the plan.
    entries = "\x02".join(f"{char}\x01{text}" for char, text in several.items())
    expansions = F.str_to_map(F.lit(entries), F.lit("\x02"), F.lit("\x01"))
    characters = F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))
    expanded = F.array_join(
        F.transform(characters, lambda c: F.coalesce(F.try_element_at(expansions, c), c)), ""
    )
    spelled_out = F.when(col.rlike("[" + "".join(several) + "]"), expanded).otherwise(col)
    one_to_one = F.translate(
        spelled_out, DASHES + "".join(single), "-" * len(DASHES) + "".join(single.values())
    )
    beyond_ascii = F.octet_length(col) != F.length(col)  # only such characters take several bytes
    return F.when(beyond_ascii, F.regexp_replace(one_to_one, NON_ASCII, "")).otherwise(col)


def blank_to_null(col: Column) -> Column:
    """Map every "no value" token to null."""
    return F.when(~col.isin(NA_TOKENS), col)
