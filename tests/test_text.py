from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from awardtrace.functions import award as A
from awardtrace.functions.text import DASHES, NA_TOKENS, ascii_fold, blank_to_null, strip, whitespace


def test_fold_equals_nfkd_for_every_character(spark):
    chars = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c not in DASHES]
    # Several characters per row, so that neighbours are covered as well.
    texts = ["a" + "".join(chars[i:i + 50]) + "b" for i in range(0, len(chars), 50)]
    rows = [(t, "".join(c for c in unicodedata.normalize("NFKD", t) if c.isascii())) for t in texts]
    df = spark.createDataFrame(rows, "text string, expected string")
    assert df.filter(ascii_fold(F.col("text")) != F.col("expected")).count() == 0


def test_strip_removes_all_whitespace(spark):
    rows = [(f"{c}x y{c}",) for c in whitespace()] + [("x y",), (f"{whitespace()}x y{whitespace()}",)]
    got = spark.createDataFrame(rows, "text string").select(strip(F.col("text")).alias("t")).distinct().collect()
    assert [r.t for r in got] == ["x y"]


def test_na_tokens(spark):
    rows = [(t,) for t in NA_TOKENS] + [("NaN ",), ("Nan",), ("0",)]
    got = spark.createDataFrame(rows, "text string").select(blank_to_null(F.col("text")).alias("t"))
    assert {r.t for r in got.collect()} == {None, "NaN ", "Nan", "0"}


def test_normalize_and_segments(spark):
    rows = [
        ("a-12/b_c.d e", "A12BCDE", ["A", "12", "B", "C", "D", "E"]),
        ("Café 01", "CAFE01", ["CAFE", "01"]),
        ("A‐12", "A12", ["A", "12"]),
        ("A–12", "A12", ["A", "12"]),
        ("A—12", "A12", ["A", "12"]),
        ("A−12", "A12", ["A", "12"]),
        ("A‑1", "A1", ["A1"]),  # the non-breaking hyphen joins its neighbours
        ("ＡＢ Ⅳ", "ABIV", ["AB", "IV"]),
        ("a\x1cb\x1fc", "ABC", ["A", "B", "C"]),
        ("---", "", []),
        ("漢字", "", []),
        ("#", "", ["#"]),
        ("", "", []),
        (None, "", []),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "id string")
    got = df.select("id", A.normalize(F.col("id")).alias("n"), A.segments(F.col("id")).alias("s")).collect()
    assert [(r.id, r.n, r.s) for r in got] == rows
