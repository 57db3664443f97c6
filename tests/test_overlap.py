from __future__ import annotations

import random

from pyspark.sql import functions as F

from awardtrace.functions import award as A
from awardtrace.functions.text import strip
from awardtrace.operators.overlap import GRAM, best_overlap, block_sizes, described, grams, short_pieces
from awardtrace.plans.reconcile import award_overlap


def awards(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "award_id string")


def brute_force(spark, corpus, funder):
    """Every candidate pair formed and tested, best one kept."""

    def described(ids):
        df = awards(spark, ids).select(
            "award_id", strip(F.col("award_id")).alias("t"), A.normalize(F.col("award_id")).alias("n"),
            A.segments(F.col("award_id")).alias("s"))
        return df.collect()

    best = {}
    right = described(funder)
    for a in described(corpus):
        found = [
            (a.t != b.t, abs(len(a.n) - len(b.n)), b.award_id)
            for b in right
            if any(s in a.s and (len(s) > 2 or not s.isdigit()) for s in b.s)
            and (a.t == b.t or a.n in b.n or b.n in a.n)
        ]
        if found:
            best[a.award_id] = min(found)
    return best


def test_best_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["GRANT", "GRANT", "R01", "12", "7", "0012", "A", "AB", "#", "é1", "B(2", "GRANTS", "COUNCIL"]

    def award():
        body = rng.choice(["-", "/", " ", "", "_"]).join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        return rng.choice(["", " ", " "]) + body + rng.choice(["", " ", "-"])

    corpus = sorted({award() for _ in range(400)})
    funder = sorted({award() for _ in range(400)})
    expected = brute_force(spark, corpus, funder)
    got = best_overlap(awards(spark, corpus), awards(spark, funder)).collect()
    assert len(expected) > 100
    assert {r.award_id: (not r.exact, r.length_gap, r.matching_input_award_id) for r in got} == expected


def test_pairs_without_shared_segment_are_not_compared(spark):
    got = best_overlap(awards(spark, ["ABC123", "12", "QR-12"]), awards(spark, ["ABC-123", "12", "XQR-12-Z"]))
    # ABC123 shares no segment; 12 is no index entry; the last one shares nothing but 12.
    assert {(r.award_id, r.matching_input_award_id) for r in got.collect()} == set()


def test_containment_may_cross_segments(spark):
    got = best_overlap(awards(spark, ["GM-12"]), awards(spark, ["1G-GM-1/2"]))
    assert [(r.award_id, r.matching_input_award_id, r.length_gap) for r in got.collect()] == [("GM-12", "1G-GM-1/2", 2)]


def test_hot_segment_stays_linear(spark):
    """All ids share a segment: 9 million candidate pairs, none of them formed."""
    n = 3000
    corpus = spark.range(n).select(F.format_string("GRANT-%06d", F.col("id") * 2).alias("award_id"))
    funder = spark.range(n).select(F.format_string("GRANT/%06d/X", F.col("id") * 3).alias("award_id"))
    sizes = block_sizes(corpus, funder).filter("segment = 'GRANT'").first()
    assert sizes.candidate_pairs == n * n
    got = award_overlap(corpus, funder)
    assert got.count() == n // 3  # the multiples of six
    assert got.select("match_type", "similarity_score").distinct().collect() == [("substring", 0.767)]


def test_long_ids_against_brute_force(spark):
    """Ids up to some hundred characters, each a part of another one or nearly so."""
    rng = random.Random(5)
    words = ["PROGRAMME", "COUNCIL", "GRANT2019", "R01", "HORIZON", "ABCDEFGHIJ", "X", "0042"]
    long = ["-".join(rng.choice(words) for _ in range(rng.randint(10, 35))) for _ in range(60)]
    parts = []
    for text in long:
        pieces = text.split("-")
        a = rng.randrange(len(pieces))
        parts += ["-".join(pieces[a:a + rng.randint(1, 12)]), "/".join(pieces[:a + 1]) + rng.choice(["", "-ZZ"])]
    corpus, funder = sorted(set(long[:30] + parts[60:])), sorted(set(long[30:] + parts[:60] + parts[90:]))
    expected = brute_force(spark, corpus, funder)
    got = best_overlap(awards(spark, corpus), awards(spark, funder)).collect()
    assert len(expected) > 60
    assert {r.award_id: (not r.exact, r.length_gap, r.matching_input_award_id) for r in got} == expected


def test_rows_grow_with_the_length_of_ids(spark):
    rng = random.Random(6)
    ids = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(16)) for _ in range(200)]
    rows = described(awards(spark, ids)).withColumn("side", F.lit(1)).withColumn("id", F.monotonically_increasing_id())
    assert grams(rows, []).count() + short_pieces(rows, {0: list(range(GRAM))}).count() < 500_000


def test_groups_do_not_meet(spark):
    """Each group alone gives what all of them give at once."""
    rng = random.Random(9)
    words = ["GRANT", "R01", "0042", "ABCDEFGHIJ", "#", "X1"]
    draw = lambda: sorted({"-".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    sides = [[(f, a) for f in "FG" for a in draw()] for _ in range(2)]
    left, right = (spark.createDataFrame(rows, "funder string, award_id string") for rows in sides)
    together = {tuple(r) for r in best_overlap(left, right, ["funder"]).collect()}
    alone = {(f, *r) for f in "FG" for r in best_overlap(*(df.filter(F.col("funder") == f).select("award_id") for df in (left, right))).collect()}
    assert together == alone and len(alone) > 40
