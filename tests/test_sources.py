from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from awardtrace.operators.clean import GRANT_COLUMNS, RAW_COLUMNS, clean_input
from awardtrace.plans import build, reconcile
from awardtrace.sources import csv, tables
from awardtrace.sources.csv import scan_input_csv
from checks.adapter import FUNDER, grants_raw

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(path, text):
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(text)
    return path


HEADER = ",".join(RAW_COLUMNS) + ",extra\n"
ROW = 'W1, 10.1/A ,grants,g.0,"{""funder"":""F1"",""award_id"":""A, \\"" 1""}",S1,10.1,p.gz,e\n'


def test_grants_csv(spark, folder):
    df = csv.scan_grants_csv(spark, put(f"{folder}/g.csv", HEADER + ROW))
    assert df.columns == RAW_COLUMNS
    row = df.first()
    assert row.doi == " 10.1/A " and row.value == '{"funder":"F1","award_id":"A, \\" 1"}'


def test_torn_and_ragged_records_are_errors(spark, folder):
    torn = put(f"{folder}/torn.csv", HEADER + ROW.replace("A, ", "A\n"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        csv.scan_grants_csv(spark, torn).collect()
    assert csv.scan_grants_csv(spark, torn, multi_line=True).count() == 1
    ragged = put(f"{folder}/ragged.csv", HEADER + ROW + "W2,10.1/b\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        csv.scan_grants_csv(spark, ragged).select("work_id").collect()
    with pytest.raises(ValueError, match="lacks"):
        csv.scan_grants_csv(spark, put(f"{folder}/short.csv", "work_id,doi\nW,d\n"))


def test_input_csv(spark, folder):
    text = 'doi,award,My Title\n10.1/a,0012,"a\nb, ""c"""\nNA,N/A,nan\n,,""\n'
    rows = csv.scan_input_csv(spark, put(f"{folder}/i.csv", text)).collect()
    assert [tuple(r) for r in rows] == [("10.1/a", "0012", 'a\nb, "c"'), (None,) * 3, (None,) * 3]
    assert csv.scan_input_csv(spark, put(f"{folder}/h.csv", "doi,award_id\n")).count() == 0


def test_csv_round_trip(spark, folder):
    rows = [(" a ", 'q"x", y', "{}"), ("l1\nl2", "\\", None)]
    df = spark.createDataFrame(rows, "doi string, award_id string, note string")
    csv.write_csv(df, f"{folder}/out")
    got = csv.scan_csv(spark, f"{folder}/out", multi_line=True).collect()
    assert sorted(map(tuple, got)) == rows


def test_build(spark, folder):
    raw = grants_raw(spark, SF)
    csv.write_csv(raw, f"{folder}/raw")
    checks = build.build_from_csv(spark, f"{folder}/raw", f"{folder}/db")
    found = {r.check_name: r for r in checks.collect()}
    # The raw table holds values that are no JSON.
    assert {name for name, r in found.items() if not r.passed} == {"value_is_json"} and found["value_is_json"].observed > 0
    assert set(found) == {
        "grants_not_empty", "some_funder_parsed", "value_is_json", "metadata_keys_unique"}
    metadata = {r.key: r.value for r in tables.read_metadata(spark, f"{folder}/db/metadata").collect()}
    table = tables.read_grants(spark, f"{folder}/db/grants")
    assert metadata["total_rows"] == str(raw.count()) == str(table.count())
    assert set(metadata) == {"source_file", "total_rows", "parsed_rows", "build_date"}
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        build.build_from_csv(spark, f"{folder}/raw", f"{folder}/db")
    build.build_from_csv(spark, f"{folder}/raw", f"{folder}/db", force=True)
    metadata, profile, top = build.database_info(spark, f"{folder}/db", 3)
    assert metadata.count() == 4
    assert profile.first().total_records == raw.count() and top.count() == 3


def test_copies_of_one_row_spread_over_files(spark, folder):
    rows = spark.range(20_000).selectExpr(
        "'W' AS work_id", "'d' AS doi", "'f' AS field_name", "'s' AS subfield_path", "'F' AS funder",
        "'a' AS award_id", "'S' AS source_id", "'p' AS doi_prefix", "'x' AS source_file_path")
    tables.write_grants(rows, f"{folder}/hot", partitions=8)
    counts = [r["count"] for r in tables.read_grants(spark, f"{folder}/hot").groupBy(
        "_metadata.file_name").count().collect()]
    assert sum(counts) == 20_000 and len(counts) > 4 and max(counts) < 8_000


def test_filter_on_funder_reaches_the_scan(spark, folder):
    from awardtrace.operators.clean import clean_grants, funder_grants

    tables.write_grants(clean_grants(grants_raw(spark, SF)), f"{folder}/grants")
    plan = funder_grants(tables.read_grants(spark, f"{folder}/grants"), FUNDER)._jdf.queryExecution().toString()
    assert "EqualTo(funder," in plan and "source_id" not in plan.split("ReadSchema")[-1]


def test_run_writes_everything(spark, folder):
    raw = put(f"{folder}/list.csv", "doi,grant,note\n10.1/A,A-1,x\n10.1/b,NA,y\n,GRANT-7,z\n10.1/q,Q,w\n")
    table = spark.createDataFrame(
        [("W1", "10.1/a", "F1", "A-1"), ("W2", "10.1/b", "F1", "B"), ("W3", "10.1/z", "F1", "GRANT/7")],
        "work_id string, doi string, funder string, award_id string")
    stats = reconcile.run(spark, raw, table, "F1", f"{folder}/out", award_field="grant")
    values = {r.metric: r.value for r in stats.collect()}
    assert values["matched"] == 1 and values["award_differs"] == 0 and values["absent_from_corpus"] == 1
    assert values["corpus_only"] == 1 and values["overlap_substring"] == 1
    assert values["pct_work_and_award_matched"] == pytest.approx(100 / 3)
    lines = [r.value for r in spark.read.text(f"{folder}/out/report").collect()]
    assert lines[0] == "RECONCILIATION REPORT" and "  matched: 1" in lines
    assert "  pct_work_and_award_matched: 33.33%" in lines and "  Overlap includes 1 input rows without DOI" in lines
    import os
    assert sorted(os.listdir(f"{folder}/out/csv")) == ["absent_from_corpus", "corpus_only", "matched"]
    results = spark.read.parquet(f"{folder}/out/results")
    assert {r.category for r in results.select("category").distinct().collect()} == {
        "matched", "absent_from_corpus", "corpus_only"}
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        reconcile.run(spark, raw, table, "F1", f"{folder}/out", award_field="grant")
    reconcile.run(spark, raw, table, "F1", f"{folder}/out", award_field="grant", force=True)


def test_files_with_other_column_orders_are_an_error(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.csv").write_text("doi,award_id,x\n10.1/a,A-1,1\n")
    (folder / "b.csv").write_text("award_id,doi,x\nB-1,10.1/b,2\n")
    for multi_line in (False, True):
        with pytest.raises(Exception, match="header|Header"):
            scan_input_csv(spark, str(folder), multi_line).collect()


def test_any_column_name_passes_through(spark, tmp_path):
    (tmp_path / "list.csv").write_text('doi,award_id,Award No.,a b,tick`ed\n10.1/a,A-1,1,2,3\n10.1/b,A-2,4,5,6\n')
    rows = clean_input(scan_input_csv(spark, str(tmp_path / "list.csv")))
    table = spark.createDataFrame([("W1", "10.1/a", "F1", "A-1")], "work_id string, doi string, funder string, award_id string")
    results = reconcile.reconcile(rows, table, "F1")
    for name in ("matched", "award_differs", "absent_from_corpus"):
        assert {"Award No.", "a b", "tick`ed"} <= set(results[name].columns)
        results[name].collect()
    assert results["matched"].count() == 1 and results["absent_from_corpus"].count() == 1
    whole = reconcile.consolidated(rows, table, "F1")
    assert whole.count() == 2
    assert reconcile.by_category(whole, rows.columns)["matched"].collect()[0]["Award No."] == "1"
    with pytest.raises(ValueError, match="clash"):
        clean_input(rows.withColumn("_pair_ratio", rows["doi"]))


def test_staging_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.staging_path(Session, "x")


@pytest.fixture
def root(monkeypatch, tmp_path):
    """A staging folder of its own."""
    monkeypatch.setattr(tables, "staging_root", lambda _: f"{tmp_path}/staging")
    (tmp_path / "staging").mkdir()
    return tmp_path / "staging"


def test_scopes_remove_what_they_staged(spark, root):
    names = lambda: sorted(p.name.split("-")[0] for p in root.iterdir())
    outside = tables.stage(spark.range(3), "outside")
    with tables.staging(spark):
        tables.stage(spark.range(4), "first")
        with tables.staging(spark) as inner:
            part = tables.stage(spark.range(5), "part")
            gone = tables.stage(spark.range(6), "gone")
            tables.drop(gone)
            tables.drop(spark.range(1))  # no staged table: left alone
            assert names() == ["first", "outside", "part"]
            kept = inner.keep(part.selectExpr("id + 1 AS id"), "kept")
        assert names() == ["first", "kept", "outside"] and kept.count() == 5
    assert names() == ["outside"] and outside.count() == 3
    with pytest.raises(ZeroDivisionError), tables.staging(spark):
        tables.stage(spark.range(1), "broken")
        1 / 0
    assert names() == ["outside"]


def test_build_and_run_leave_nothing_behind(spark, root, folder):
    csv.write_csv(grants_raw(spark, SF), f"{folder}/raw")
    build.build_from_csv(spark, f"{folder}/raw", f"{folder}/db")
    table = tables.read_grants(spark, f"{folder}/db/grants")
    put(f"{folder}/list.csv", f"doi,award_id,funder,no.\n10.5555/ord.2,DMS-0000001,{FUNDER},1\n10.5555/x,A,{FUNDER},2\n,B,F9,3\n")
    for funder in (FUNDER, None):
        stats = reconcile.run(spark, f"{folder}/list.csv", table, funder, f"{folder}/out", force=True)
        assert list(root.iterdir()) == [] and stats.count() > 20
        assert spark.read.text(f"{folder}/out/report").filter("value = 'RECONCILIATION REPORT'").count() >= 1
        assert spark.read.parquet(f"{folder}/out/products").columns[-2:] == ["doi", "pairs"]


def test_a_build_reads_its_source_once(spark, root, monkeypatch, folder):
    """The range partitioning takes its splitters from a written table."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        calls.add(1)
        return value

    rows = spark.range(100).select(*[F.lit("x").alias(c) for c in RAW_COLUMNS if c != "value"], F.col("id").cast("string").alias("f"))
    cleaned = rows.select(*[F.lit("x").alias(c) for c in GRANT_COLUMNS if c != "funder"], counted("f").alias("funder"))
    tables.write_grants(cleaned, f"{folder}/grants")
    assert calls.value == 100 and tables.read_grants(spark, f"{folder}/grants").count() == 100 and list(root.iterdir()) == []


def test_categories_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """A row's category names its folder; sorting all rows by it first would spill on large results."""
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "matched").otherwise("corpus_only").alias("category"), "id")
    seen = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (
        seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")), write(self, path))[1])
    tables.write_by_category(rows, f"{tmp_path}/results")
    assert int(seen[0]) >= 4 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    read = spark.read.schema(rows.schema).parquet(f"{tmp_path}/results")
    assert sorted(map(tuple, read.select("category", "id").collect())) == sorted(map(tuple, rows.collect()))


def test_a_query_builds_only_the_tables_it_reads(spark, tmp_path, monkeypatch):
    from checks import adapter

    made = []
    monkeypatch.setattr(adapter, "_BUILT", {})
    monkeypatch.setattr(adapter, "_make", lambda spark, sf_dir, table, path: (
        made.append(table), spark.range(1).write.parquet(path)))
    adapter.funder_list(spark, str(tmp_path))
    adapter.funder_list(spark, str(tmp_path))
    assert made == ["input"]
    adapter.grants(spark, str(tmp_path))
    assert made == ["input", "grants"]
    adapter.all_lists(spark, str(tmp_path))
    assert made == ["input", "grants", "listed"]


def test_a_list_that_lies_in_many_tasks_is_not_shuffled(spark, tmp_path):
    rows = spark.range(100, numPartitions=3).select(F.col("id").cast("string").alias("doi"))
    tables.write_input(rows, f"{tmp_path}/as_is", spread=False)
    tables.write_input(rows.coalesce(1), f"{tmp_path}/spread")
    files = [len(spark.read.parquet(f"{tmp_path}/{name}").inputFiles()) for name in ("as_is", "spread")]
    assert files == [3, spark.sparkContext.defaultParallelism]
