"""Quality rules on repetition: characters inside n-grams and lines that a text repeats.

Rolling hashes of several n-gram lengths run over the words of a text in numpy; the
words of every n-gram seen twice or more are marked, and the characters of marked
words are compared with all characters in words. Lines are treated alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, text_or_empty

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed rule: fewer words, or more than so many percent of the words in repeated windows, fail.
LEAST_WORDS, WINDOW, MOST_PERCENT = 10, 5, 20
#: Share of the characters in words that repeated n-grams of a length may hold, and repeated lines.
MOST_IN_NGRAMS = {5: 0.20, 8: 0.16, 12: 0.12}
MOST_IN_LINES = 0.30

_FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "dup_chars_5 double, dup_chars_8 double, dup_chars_12 double, dup_line_chars double")
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread small integers over 64 bits."""
    x = values.astype(np.uint64) * np.uint64(_FACTOR)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def in_repeats(ids: np.ndarray, n: int) -> np.ndarray:
    """Whether each word stands in an n-gram that occurs twice or more, the first included."""
    marked = np.zeros(len(ids), dtype=bool)
    if len(ids) <= n:
        return marked
    words = _mixed(ids)
    count = len(ids) - n + 1
    rolled = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(_FACTOR) + words[k:k + count]
    order = np.sort(rolled)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if len(again):
        at = np.flatnonzero(np.isin(rolled, again))
        edges = np.zeros(len(ids) + 1, dtype=np.int32)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + n, -1)
        marked = np.cumsum(edges[:-1]) > 0
    return marked


def measure(text: str) -> tuple:
    """The measures of one text, in the order of the result's fields."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACE))
    n_dup_lines = sum(lines.values()) - len(lines)
    line_chars = sum((n - 1) * _visible(line) for line, n in lines.items() if n > 1)
    shares, repeated = [], 0
    if len(words) > len(seen):
        lengths = np.array([len(w.decode("utf-8", "surrogatepass")) for w in seen])[ids]
        for n in MOST_IN_NGRAMS:
            marked = in_repeats(ids, n)
            shares.append(float(lengths[marked].sum()) / word_chars)
            if n == WINDOW:
                repeated = int(marked.sum())
            if not marked.any():  # then no longer n-gram repeats either
                break
    shares += [0.0] * (len(MOST_IN_NGRAMS) - len(shares))
    return (len(words), word_chars, sum(text.count(c) for c in SYMBOLS), n_dup_lines, repeated, *shares,
            line_chars / word_chars if word_chars else 0.0)


def _visible(line: str) -> int:
    return len(line) - sum(line.count(c) for c in SPACE)


def rated(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` nested under ``row``, with the measures, ``base_failed`` and ``kept``.

    Shares are of the characters in words, from 0 to 1; repeated lines count from the
    second on. A null or empty text has no words and fails; a very long one is measured
    whole, in time and memory that grow with it. An empty table gives no rows.
    """
    @F.pandas_udf(_FIELDS)
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in _FIELDS.split(", ")]
        for batch in texts:
            yield pd.DataFrame([measure(t) for t in batch], columns=names)

    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), text_or_empty(text).alias("_text"))
    rows = rows.withColumn("_m", measured("_text")).select("row", "_m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_PERCENT)
    fine = F.col("dup_line_chars") <= MOST_IN_LINES
    for n, most in MOST_IN_NGRAMS.items():
        fine = fine & (F.col(f"dup_chars_{n}") <= most)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op4_quality_rules(spark, sf_dir):
    return rated(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "*").drop("row")


def _sql() -> str:
    grams = ", ".join(rf"""
g{n} AS (SELECT r, i, w, size, CASE WHEN i <= n_words - {n} THEN string_agg(w, ' ') OVER (
  PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g FROM w),
m{n} AS (SELECT r, size, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS marked
  FROM (SELECT r, i, size, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM g{n})),
s{n} AS (SELECT r, sum(size) FILTER (marked) AS chars, count(*) FILTER (marked) AS words FROM m{n} GROUP BY r)"""
                     for n in MOST_IN_NGRAMS)
    joins = " ".join(f"LEFT JOIN s{n} USING (r)" for n in MOST_IN_NGRAMS)
    shares = ", ".join(f"coalesce(s{n}.chars / nullif(word_chars, 0), 0)::DOUBLE AS dup_chars_{n}" for n in MOST_IN_NGRAMS)
    fine = " AND ".join(f"dup_chars_{n} <= {most}::DOUBLE" for n, most in MOST_IN_NGRAMS.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n_words, length(unnest(ws)) AS size FROM d), {grams},
lines AS (SELECT r, line, count(*) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS size
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
l AS (SELECT r, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * size) AS chars FROM lines GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(s{WINDOW}.words, 0) AS n_repeat_words, {shares},
         coalesce(l.chars / nullif(word_chars, 0), 0)::DOUBLE AS dup_line_chars
  FROM d {joins} LEFT JOIN l USING (r))
SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_PERCENT} AS base_failed,
       NOT base_failed AND dup_line_chars <= {MOST_IN_LINES}::DOUBLE AND {fine} AS kept
FROM m
"""


OP4_SQL = _sql()
