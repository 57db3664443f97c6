from __future__ import annotations

import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from awardtrace.functions import award as A
from awardtrace.functions.ratio import similarity_ratio
from awardtrace.operators.pairs import DEFAULT_TIERS, score_pairs
from checks.oracles import FULL_TYPE, _scored, _with


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


def placed(spark, rows):
    """The rows with their place, as scored pairs come back in any order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")


def typed(spark, rows, tiers=DEFAULT_TIERS):
    found = score_pairs(placed(spark, rows), "a", "b", tiers, False).orderBy("i")
    return [(r.match_type, r.is_match) for r in found.collect()]


def scores(spark, rows):
    return [r.similarity_score for r in score_pairs(placed(spark, rows), "a", "b").orderBy("i").collect()]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("GM", "GM", True),
        ("007", "7", True),
        ("000", "0", True),
        ("2019", "19", True),
        ("19", "2019", True),
        ("2019", "20", False),
        ("12019", "19", False),
        ("99999999999999999999999999", "0099999999999999999999999999", True),
        ("12", "A12", False),
        ("A12", "12", False),
        ("GM12", "GM12X", True),
        ("GM12X3", "GM12X", True),
        ("GM1", "GM12", False),  # a prefix, but another number and the same letters
        ("GM012", "GM12", True),
        ("GM1", "GM2", False),
        ("GM1A2", "GM1A3", True),  # only the first number counts here
        ("AB", "AB12", True),
        ("XAB", "AB", True),
        ("XAB1", "AB", True),
        ("ABC", "ABD", False),
    ],
)
def test_segment_rules(spark, a, b, expected):
    df = frame(spark, [(a, b)]).select(A.segment_struct(F.col("a")).alias("x"), A.segment_struct(F.col("b")).alias("y"))
    assert df.select(A.segments_compatible(F.col("x"), F.col("y"))).first()[0] is expected


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("", "A", (False, 0.0)),
        ("A-B-C-D", "A", (False, 0.0)),  # more than two segments apart
        ("A-B-C", "A", (False, 1 / 3)),
        ("12-A-B", "13-A-B", (False, 0.0)),  # numbers clash in the first place
        ("A-B-C-12", "A-B-C-13", (False, 0.75)),  # and in the last: no match in spite of the share
        ("A-B-C-12", "A-B-C-13-D", (False, 0.6)),  # the last place of the shorter id
        ("A-12-B-C", "A-13-B-C", (True, 0.75)),  # a clash in between only costs its share
        ("A-2019-7", "A-19-007", (True, 1.0)),
        ("1-A", "2-A", (False, 0.0)),
    ],
)
def test_structured_match(spark, a, b, expected):
    df = A.with_features(A.with_features(frame(spark, [(a, b)]), "a", "l_"), "b", "r_")
    df = df.withColumn("c", A.structured_confidence(F.col("l_segs"), F.col("r_segs")))
    row = df.select(A.structured_match(F.col("l_segs"), F.col("r_segs"), F.col("c")).alias("m"), "c").first()
    assert (row.m, row.c) == (expected[0], pytest.approx(expected[1]))


def test_match_types(spark):
    cases = [
        ((" A-1 ", "A-1"), ("exact", True)),
        (("DMS0001", "DMS-0001"), ("substring", True)),
        (("---", "XYZ"), ("substring", True)),  # nothing left after normalising: contained in everything
        (("", "XYZ"), (None, False)),
        (("  ", ""), ("exact", True)),
        (("A-12-B-C", "A-13-B-C"), ("fuzzy", True)),
        (("ABC", "ABD"), (None, False)),
        (("TIDE", "DIET"), (None, False)),
        ((None, "A"), (None, None)),
        ((None, None), (None, None)),
    ]
    assert typed(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_normalized_tier_needs_its_own_list(spark):
    rows = [("DMS0001", "DMS-0001"), ("DMS0001", "DMS-00012"), ("---", "+++")]
    assert typed(spark, rows) == [("substring", True)] * 3
    assert typed(spark, rows, ["normalized"]) == [("normalized", True), (None, False), ("normalized", True)]
    with pytest.raises(ValueError, match="unknown tiers"):
        typed(spark, rows, ["near"])


def test_ratio_limits(spark):
    """One letter off in twenty passes 0.90, one digit off needs 0.95."""
    letters, changed = "PROGRAMMEFORSCIENCEX", "PROGRAMMEFORSCIENZEX"
    rows = [
        (f"AB-{letters}", f"AB-{changed}"),
        (f"AB-{letters}1", f"AB-{changed}1"),
        ("AB-ABCDEFGH", "AB-ABQQEFGH"),
    ]
    assert typed(spark, rows) == [("fuzzy", True), ("fuzzy", True), (None, False)]
    short = [("AB-ABCDEFGH1", "AB-ABCDQFGH1")]
    assert SequenceMatcher(None, "ABABCDEFGH1", "ABABCDQFGH1").ratio() > 0.90
    assert typed(spark, short) == [(None, False)]


def test_ratio_depends_on_order(spark):
    rows = [("TIDE", "DIET"), ("DIET", "TIDE"), ("", "A"), (None, "A"), ("a" * 300, "b" + "a" * 299)]
    got = [r[0] for r in frame(spark, rows).select(similarity_ratio("a", "b")).collect()]
    assert got == [0.25, 0.5, 0.0, None, SequenceMatcher(None, *rows[4]).ratio()]


def test_scores(spark):
    cases = [
        (("A-1", " A-1"), 1.0),
        (("A-1", "A1"), 0.95),
        (("---", "+++"), 0.95),
        (("1-2-A", "1-3-A"), 2 / 3),  # two numbers on both sides: the share alone
        (("---", "ABC"), 0.9),
        (("ABCD", "ABCDE"), 0.9),  # 8/9 would be less
        (("AB-12", "AB-13"), 0.6),  # capped at half plus a tenth
        ((None, "A"), None),
    ]
    assert scores(spark, [c[0] for c in cases]) == [pytest.approx(c[1]) if c[1] else None for c in cases]


def test_common_substring_and_overlap_of_characters(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("AB1", k=rng.randint(0, 12))) for _ in range(300)]
    rows = [(rng.choice(words), rng.choice(words)) for _ in range(400)]

    def longest(a, b):
        return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)

    def overlap(a, b):
        return len(set(a) & set(b)) / min(len(set(a)), len(set(b))) if a and b else 0.0

    got = frame(spark, rows).select(
        "a", "b", A.common_substring_length(F.col("a"), F.col("b")).alias("n"),
        A.overlap_coefficient(F.col("a"), F.col("b")).alias("o"),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.o) == (longest(r.a, r.b), pytest.approx(overlap(r.a, r.b)))


def test_random_ids_equal_sql(spark):
    """Types and scores of random ids, native rules with pruned ratio against SQL that leaves nothing out."""
    rng = random.Random(11)
    parts = ["R01", "GM", "GM12", "gm012", "12", "0012", "2019", "19", "7", "A", "AB", "AB3", "COUNCIL", "#", "Council1"]

    def award():
        return "".join(rng.choice(parts) + rng.choice(["-", "/", " ", "", "."]) for _ in range(rng.randint(0, 5)))

    def near(text):
        if not text or rng.random() < 0.4:
            return award()
        i = rng.randrange(len(text))
        return text[:i] + rng.choice(["", "X", "1", "-"]) + text[i + rng.randint(0, 1):]

    firsts = [award() for _ in range(1500)]
    rows = sorted({(a, near(a)) for a in firsts})
    con = duckdb.connect()
    con.register("random_pairs", pd.DataFrame(rows, columns=["id1", "id2"]))
    sql = _with("SELECT id1, id2, match_type, similarity_score FROM scored", _scored("random_pairs", FULL_TYPE))
    expected = sorted(con.execute(sql).fetchall())
    df = score_pairs(frame(spark, rows), "a", "b")
    got = sorted((r.a, r.b, r.match_type, r.s) for r in df.withColumn("s", F.round("similarity_score", 3)).collect())
    assert len({r[2] for r in got}) == 4
    assert got == expected
    assert all(0.0 <= r[3] <= 1.0 for r in got)


def test_ratio_equals_difflib():
    """Around 200 characters, from where on difflib sets frequent characters aside, and for short ids."""
    import random

    from awardtrace.functions.ratio import ratios

    rng = random.Random(2)
    pairs = []
    for n in (0, 1, 7, 30, 198, 199, 200, 201, 350):
        for letters in ("AB", "ABCDEFGH0123456789", "AAAAAAAAAAAAAAABCDEFGHIJKLMNOP"):
            for m in (n, max(0, n - 9), 25):
                pairs += [("".join(rng.choice(letters) for _ in range(m)), "".join(rng.choice(letters) for _ in range(n)))
                          for _ in range(4)]
    got = ratios([a for a, _ in pairs], [b for _, b in pairs])
    want = [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert got.tolist() == want


def test_a_query_writes_only_the_features_it_compares(spark, monkeypatch):
    from awardtrace.operators import pairs
    from checks.registry import QUERIES

    columns = {}
    write = pairs.stage
    monkeypatch.setattr(pairs, "stage", lambda df, name: (columns.update({name: df.columns}), write(df, name))[1])
    for name, wanted in (("pair_substring", ["trimmed", "norm"]), ("pair_edit_distance", ["norm"]), ("overlap_coefficient", ["norm"])):
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert columns.pop("award-features") == ["_pair_id", *[f"_pair_{c}" for c in wanted]]


def test_the_further_key_of_a_join_is_small(spark):
    from awardtrace.operators.joins import skew_join

    rows = spark.range(5000).select(F.concat(F.lit("10.5555/"), "id").alias("k"))
    plan = skew_join(rows, rows.withColumn("n", F.lit(1)), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "& 255" in plan and "xxhash64" not in plan
    assert skew_join(rows, rows.withColumn("n", F.lit(1)), ["k"]).count() == 5000
