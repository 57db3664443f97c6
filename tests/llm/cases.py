"""Small document tables with the cases every operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves or that need quoting.
    T.StructField("row", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("_key", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("a.b`c", T.StringType()),
])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty, blank, very long, equal, repeated and near-equal texts."""
    long = prose(1, 20_000)
    base = prose(2, 120)
    near = base.replace(base.split()[60], "changed", 1)
    lined = "one line of words here\n" * 12 + "and a last one"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, base), (6, base), (7, near), (8, base.replace(" ", "\n  ")),
            (9, "word"), (10, "two words"), (11, "two words"), (12, lined), (13, "Ünïcödé 😀 ▁ 梦 " * 30), (None, base),
            (None, None), (5, base), (14, "same again " * 200)]
    rows += [(100 + i, prose(100 + i, 40)) for i in range(30)]
    rows += [(200 + i, "a text that has very many copies in this table and stays one of them") for i in range(40)]
    rows += [(300 + i, base + " and tail number " + str(i)) for i in range(10)]
    return rows


def documents(spark, rows=None):
    """A DataFrame of the cases, sources and languages null at times."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([
        (k, t, [None, "en", "de"][i % 3], [None, "web", "web", "books", "Zines"][i % 5], len(t or ""), "r", "t", -1, -2, "k", "q")
        for i, (k, t) in enumerate(rows)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
