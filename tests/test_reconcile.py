from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from awardtrace.operators import clean, doi, overlap, profiles
from awardtrace.operators.joins import (
    anti_join_spreading_nulls, keep_if_small_keys, left_join_spreading_nulls, skew_join,
)
from awardtrace.operators.pairs import STRICT_TIERS
from awardtrace.plans import reconcile, report
from awardtrace.sources import tables
from checks.adapter import FUNDER, all_lists, funder_list, grants

SF = "/root/testdata/sf0.001"
F1, F2 = "F1", "F2"


def corpus(spark, rows):
    return spark.createDataFrame(rows, "work_id string, doi string, funder string, award_id string")


def listed(spark, rows):
    return spark.createDataFrame(rows, "doi string, award_id string, note string")


@pytest.fixture(scope="module")
def small(spark):
    table = corpus(spark, [
        ("W1", "10.1/a", F1, "A-1"),
        ("W1", "10.1/a", F1, "B-2"),
        ("W1", "10.1/a", F1, "A-1"),
        ("W2", "10.1/b", F1, None),
        ("W3", "10.1/c", F2, "C-3"),
        ("W0", "10.1/c", F2, "C-4"),
        ("W4", "10.1/d", F1, "GRANT-7"),
        ("W5", None, F1, "GRANT-8"),
        ("W6", "10.1/e", F1, None),
        ("W7", "10.1/f", None, "A-1"),
    ])
    rows = listed(spark, [
        ("10.1/a", "A-1", "x"),
        ("10.1/a", "A-1", "x"),
        ("10.1/a", None, "y"),
        ("10.1/b", "B-9", "z"),
        ("10.1/b", None, "z"),
        ("10.1/c", "C-3", "u"),
        ("10.1/q", "Q-1", "v"),
        (None, "GRANT 7", "w"),
        (None, "X/GRANT-8", "w"),
    ])
    return rows, table


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_four_results(small):
    results = reconcile.reconcile(*small, F1)
    assert values(results["matched"]) == [("10.1/a", "x", "A-1", "A-1", "W1", "exact", 1.0)]
    # The same input row is also compared with the other award of its DOI.
    differs = results["award_differs"].drop("similarity_score")
    assert values(differs) == [("10.1/a", "A-1", "x", "A-1", "B-2", "W1", "no_match")]
    assert results["award_differs"].columns[:3] == ["doi", "award_id", "note"]
    # Known under another funder: one work, always the smallest.
    assert values(results["absent_from_corpus"]) == [
        ("10.1/c", "C-3", "u", "W0"), ("10.1/q", "Q-1", "v", None)]
    assert values(results["corpus_only"].drop("similarity_score")) == [
        ("W4", "10.1/d", "GRANT-7", "GRANT 7", True, None, "substring"),
        ("W5", None, "GRANT-8", "X/GRANT-8", True, None, "substring"),
        ("W6", "10.1/e", None, None, False, True, None),
    ]


def test_missing_awards_are_kept_on_request(small):
    rows = doi.award_differs(doi.compare_on_doi(*small, F1, emit_missing=True)).filter("match_type = 'missing'")
    kept = rows.select("doi", "award_id", "corpus_award_id", "similarity_score")
    assert values(kept) == [
        ("10.1/a", None, "A-1", 0.0), ("10.1/a", None, "B-2", 0.0),
        ("10.1/b", "B-9", None, 0.0), ("10.1/b", None, None, 1.0)]


def test_overlap_from_rows_without_doi(small):
    only = reconcile.corpus_only(*small, F1)
    assert tuple(report.overlap_from_no_doi(only, small[0]).first()) == (2, 1)
    assert tuple(report.overlap_breakdown(only).first()) == (3, 2, 1, 0, 2, 0, 0)


def test_consolidated_splits_into_the_same_results(small):
    apart = reconcile.reconcile(*small, F1)
    together = reconcile.by_category(reconcile.consolidated(*small, F1), small[0].columns)
    for name in reconcile.CATEGORIES:
        assert together[name].columns == apart[name].columns
        assert values(together[name]) == values(apart[name])


def test_empty_sides(spark, small):
    rows, table = small
    for args in [(rows.limit(0), table, F1), (rows, table, "F9"), (rows.withColumn("doi", F.lit(None).cast("string")), table, F1)]:
        results = reconcile.consolidated(*args)
        row = report.summary(*args, results).first()
        assert row.matched == 0 and row.award_differs == 0
        lines = [r.line for r in report.report_lines(report.summary(*args, results), args[2], "in").collect()]
        assert not any(line.startswith("Match types") for line in lines)
        assert any(line.startswith("Percentages") for line in lines) == (row.records_with_doi > 0)
    assert row.pct_work_and_award_matched is None
    assert row.corpus_only == 6


def test_clean_input(spark):
    rows = [(" 10.1/A \t", "1"), ("nan", "2"), ("NaN ", "3"), (" ", "4"), (None, "5"), (" 10.1/B ", "6")]
    raw = spark.createDataFrame(rows, "doi string, grant string")
    cleaned = clean.clean_input(raw, award_field="grant")
    assert [tuple(r) for r in cleaned.collect()] == [
        ("10.1/a", "1"), (None, "2"), ("nan", "3"), (None, "4"), (None, "5"), ("10.1/b", "6")]
    with_doi, without = clean.split_by_doi(cleaned)
    assert (with_doi.count(), without.count()) == (3, 3)
    for bad in ("work_id", "Match_Type", "_l_norm"):
        with pytest.raises(ValueError, match="clash"):
            clean.clean_input(raw.withColumnRenamed("grant", "award_id").withColumn(bad, F.lit("x")))
    with pytest.raises(ValueError, match="lacks"):
        clean.clean_input(raw)
    with pytest.raises(ValueError, match="both"):
        clean.clean_input(raw.withColumn("award_id", F.lit("x")), award_field="grant")


def test_json_cases(spark):
    cases = [
        ('{"funder":"F1","award_id":"A"}', "F1", "A"), ('{"funder":"F1"}', "F1", None),
        ('{"funder":null,"award_id":12}', None, "12"), ('{"funder":"a\\"b","award_id":1.50}', 'a"b', "1.5"),
        ('{"funder":{"a": 1},"award_id":[1, 2]}', '{"a":1}', "[1,2]"), ('{"award_id":true,"funder":""}', "", "true"),
        ('{"funder":"F1","funder":"F2","award_id":"A"}', "F1", "A"),
        ('{"funder":"F1", bad', None, None), ("no json", None, None), (None, None, None),
        ('{"funder":"F1","award_id":"A"} junk', None, None), ("{'funder':'F1','award_id':'A'}", None, None),
        ('{"funder":"F1"},{"funder":"F2"}', None, None), ('{"funder":"F1"}] , [2', None, None), ('{"funder":NaN}', None, None),
        ('{"funder":"F1"', None, None), ("", None, None),
        # Text behind the value that looks like the end of an array, with or without a guess at what stands there.
        ('{"funder":"a","award_id":"1"},"end of value"] junk', None, None), ('{"funder":"a"},0] junk', None, None),
        ('{"funder":"a"},{"funder":"0cc175b9c0f1b6a831c399e269772661"}] x', None, None), ("[1]", None, None), ("7", None, None),
        ('{"x":{"funder":"in"},"funder":"out"}', "out", None), ('{"f\\u0075nder":"esc","funder":"F2"}', "esc", None),
        ('{"award_id":null,"award_id":"B"}', None, "B"), ('{"funder":"a\\u0062"}', "ab", None), ("null", None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "value string")
    assert [tuple(r) for r in clean.extract_json(df).collect()] == cases
    raw = df.select(*[F.lit("x").alias(c) for c in clean.RAW_COLUMNS if c != "value"], "value")
    bad = profiles.json_checks(clean.clean_and_flag(raw)).first()
    assert (bad.passed, bad.observed) == (False, 12)


def test_top_funders_breaks_ties(spark):
    table = corpus(spark, [("W", "d", f, "a") for f in ["F3", "F2", "F1", "F2", "F1", None, None, None]])
    assert values(profiles.top_funders(table, 2)) == [("F1", 2), ("F2", 2)]


def test_results_cover_the_joined_rows(spark):
    rows, table = funder_list(spark, SF), grants(spark, SF)
    compared = doi.compare_on_doi(rows, table, FUNDER)
    known = rows.filter("doi IS NOT NULL AND award_id IS NOT NULL").distinct()
    mine = clean.funder_grants(table, FUNDER).filter("award_id IS NOT NULL").withColumnRenamed("award_id", "c")
    joined = known.join(mine, "doi").count()
    assert doi.matched(compared).count() + doi.award_differs(compared).count() == joined
    bounds = compared.agg(F.min("similarity_score").alias("low"), F.max("similarity_score").alias("high")).first()
    assert 0.0 <= bounds.low and bounds.high == 1.0
    assert compared.filter("match_type = 'exact' AND similarity_score <> 1").count() == 0
    absent = doi.absent_from_corpus(rows, table, FUNDER)
    assert absent.join(mine, "doi", "left_semi").count() == 0
    only = reconcile.corpus_only(rows, table, FUNDER)
    assert only.join(doi.input_dois(rows), "doi", "left_semi").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rows, table = funder_list(spark, SF), grants(spark, SF)
    plain = reconcile.consolidated(rows, table, FUNDER, STRICT_TIERS)
    shuffled = reconcile.consolidated(
        rows.repartition(3, "award_id"), table.repartition(5, "work_id"), FUNDER, STRICT_TIERS)
    assert values(plain) == values(shuffled)


def test_a_doi_with_a_third_of_all_rows(spark):
    """Copies of one DOI and award are merged before the join: one row, not their product."""
    hot = spark.range(20_000).select(F.lit("10.1/hot").alias("doi"), F.lit("A-1").alias("award_id"))
    cold = spark.range(1_000).select(F.format_string("10.1/%d", "id").alias("doi"), F.lit("A-2").alias("award_id"))
    rows = hot.unionByName(cold)
    table = rows.select(F.lit("W").alias("work_id"), "doi", F.lit(F1).alias("funder"), "award_id")
    assert doi.matched(doi.compare_on_doi(rows, table, F1)).count() == 1_001


@pytest.mark.parametrize("limit", [0, 10_000])
def test_filter_by_few_keys_changes_no_result(spark, small, limit):
    rows, table = small
    kept = keep_if_small_keys(table, doi.input_dois(rows), "doi", limit)
    assert kept.count() == (10 if limit == 0 else 6)
    assert values(doi.doi_profile(kept, F1).join(doi.input_dois(rows), "doi")) == values(
        doi.doi_profile(table, F1).join(doi.input_dois(rows), "doi"))


@pytest.fixture
def small_partitions(spark):
    """Make AQE take a few hundred kilobytes for a large partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def splits(df):
    """Whether the joins of the executed plan were split."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, small_partitions):
    """A third of all distinct rows on one key, against a side that is grouped by it."""
    left = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    ).repartition(8, "id")
    right = left.groupBy("k").agg(F.max("id").alias("m"))
    joined = skew_join(left, right, ["k"], "left")
    assert splits(joined) and joined.count() == 60_000
    assert not splits(left.join(right, "k", "left"))
    spread = left_join_spreading_nulls(left, right, "k", ["id"])
    assert splits(spread) and spread.filter("m IS NOT NULL").count() == 60_000


def test_rows_without_key_go_to_many_tasks(spark, small_partitions):
    left = spark.range(20_000).select(F.when(F.col("id") < 0, "x").alias("k"), "id").repartition(4, "id")
    right = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("one"))
    out = left_join_spreading_nulls(left, right, "k", ["id"]).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4_000
    assert anti_join_spreading_nulls(left, right.select("k"), "k", ["id"]).count() == 20_000


def scans(df):
    """Files that the executed plan of a query reads, by folder, and the joins in it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Join")


def test_each_table_is_read_once(spark, small, tmp_path, monkeypatch):
    """The DOI join and the features of ids run once; what is left reads what they wrote."""
    rows, table = small
    rows.write.parquet(f"{tmp_path}/rows")
    table.write.parquet(f"{tmp_path}/table")
    rows, table = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/table")
    staged = []
    write = tables.stage
    monkeypatch.setattr(doi, "stage", lambda df, name: (staged.append((name, scans(df))), write(df, name))[1])
    compared = doi.compare_on_doi(rows, table, F1, STRICT_TIERS, with_score=False)
    # The list meets what the first table left of the corpus.
    assert [(name, n) for name, (n, _) in staged] == [("assertions", 1), ("doi-join", 2)]
    assert "rows" not in "".join(f for f in compared.inputFiles() if "staged" in f)
    assert not [f for f in compared.inputFiles() if f.startswith((f"file://{tmp_path}/rows", f"file://{tmp_path}/table"))]


def test_features_stand_above_the_distinct_of_ids(spark, monkeypatch):
    """Normalising is done once for each id, however many pairs it is in."""
    from awardtrace.operators import pairs

    plans = []
    write = pairs.stage
    monkeypatch.setattr(pairs, "stage", lambda df, name: (
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    rows = spark.createDataFrame([("A-1", "B/2")] * 5 + [("A-1", "C"), (None, "C")], "a string, b string")
    scored = pairs.score_pairs(rows, "a", "b", tiers=("structured",), with_score=False)
    assert scored.count() == 7
    name, plan = plans[0]
    # A plan is printed from its top: below the step that takes both sides' ids nothing is normalised.
    top, below = plan.split("Generate", 1)
    assert name == "award-features" and "Aggregate" in top and "[^A-Za-z0-9]" in top and "[^A-Za-z0-9]" not in below
    # The verdict reads the confidence, it does not work it out again.
    assert "zip_with" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_a_placeholder_doi_on_both_sides(spark, monkeypatch):
    """10,000 rows on each side under ten ids: a hundred pairs are scored, and no more than rows times ids are joined."""
    left = spark.range(10_000).select(F.lit("10.1/none").alias("doi"), F.format_string("A-%d", F.col("id") % 10).alias("award_id"),
                                      F.col("id").cast("string").alias("note"))
    right = spark.range(10_000).select(F.format_string("W%d", "id").alias("work_id"), F.lit("10.1/none").alias("doi"),
                                       F.lit(F1).alias("funder"), F.format_string("A-%d", F.col("id") % 10).alias("award_id"))
    scored, joined = [], []
    score, write = doi.score_pairs, tables.stage
    monkeypatch.setattr(doi, "score_pairs", lambda df, *a: (scored.append(df.count()), score(df, *a))[1])
    monkeypatch.setattr(doi, "stage", lambda df, name: (out := write(df, name), joined.append(out.count()))[0])
    compared = doi.compare_on_doi(left, right, F1, STRICT_TIERS, with_score=False)
    assert scored == [100] and joined == [10_000, 100_000]
    assert compared.count() == 10 ** 8 and doi.matched(compared).count() == 10 ** 7
    few = doi.compare_on_doi(left.limit(30), right.limit(50), F1, STRICT_TIERS, with_score=False)
    assert few.count() == 1500


def test_all_funders_at_once_equal_each_alone(spark):
    rows, table = all_lists(spark, SF), grants(spark, SF)
    together = reconcile.consolidated(rows, table, None)
    apart = reconcile.by_category(together, rows.columns)
    stats = report.statistics(report.summary(rows, table, None, together)).cache()
    funders = [r.funder for r in stats.select("funder").distinct().collect()]
    assert len(funders) == 6 and rows.filter("funder IS NULL").count() > 0  # one is in the list only
    for funder in sorted(funders)[:2] + sorted(funders)[-2:]:
        own = rows.filter(F.col("funder") == funder)
        alone = reconcile.consolidated(own, table, funder)
        for name, result in reconcile.by_category(alone, rows.columns).items():
            result = result.drop("funder")
            assert values(apart[name].filter(F.col("funder") == funder).select(*[f"`{c}`" for c in result.columns])) == values(result)
        expected = report.statistics(report.summary(own, table, funder, alone))
        assert values(stats.filter(F.col("funder") == funder).drop("funder")) == values(expected)


def test_a_list_for_all_funders_needs_their_names(spark, small, tmp_path):
    with pytest.raises(ValueError, match="funder"):
        (tmp_path / "list.csv").write_text("doi,award_id\n10.1/a,A-1\n")
        reconcile.run(spark, f"{tmp_path}/list.csv", small[1], None, f"{tmp_path}/out")


def test_null_awards_and_funders_for_all(spark, small):
    rows, table = small
    listed = rows.withColumn("funder", F.when(F.col("doi") == "10.1/q", None).otherwise(F.lit(F1)))
    both = doi.award_differs(doi.compare_on_doi(listed, table, None, emit_missing=True)).filter("match_type = 'missing'")
    assert both.count() == 4 and both.select("funder").distinct().count() == 1
    assert values(doi.absent_from_corpus(listed, table, None).select("doi", "work_id")) == [("10.1/c", "W0")]


def test_copies_of_absent_rows_merge_behind_the_join(spark, small_partitions):
    """The list is shuffled once whole, for the join; its copies and its acknowledged rows are gone before the distinct."""
    rows = spark.createDataFrame([("10.1/a", "A", "p")] * 3 + [("10.1/b", "B", "p")] * 2 + [("10.1/c", None, None)] * 2,
                                 "doi string, award_id string, note string")
    table = spark.createDataFrame([("W2", "10.1/a", "F2"), ("W1", "10.1/a", "F2"), ("W3", "10.1/b", F1)],
                                  "work_id string, doi string, funder string")
    absent = doi.absent_from_corpus(rows, table, F1)
    assert sorted(map(tuple, absent.collect()), key=str) == [("10.1/a", "A", "p", "W1"), ("10.1/c", None, None, None)]
    plan = absent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")


def test_segments_are_worked_out_once(spark, monkeypatch):
    """The filter of ids without indexed segments reads the written ones."""
    plans = []
    write = overlap.stage
    monkeypatch.setattr(overlap, "stage", lambda df, name: (
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), write(df, name))[1])
    ids = spark.createDataFrame([("AB-1234567",), ("12",), ("--",)], "award_id string")
    found = overlap.best_overlap(ids, ids)
    assert [r.award_id for r in found.collect()] == ["AB-1234567"]
    name, plan = plans[0]
    assert name == "overlap-rows" and plan.count("array_distinct") == 2  # one for each side
