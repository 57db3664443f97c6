"""Views that give the driver's tables the shape of raw corpus assertions and of a funder's list.

One SQL text serves Spark and DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from awardtrace.operators.clean import clean_grants, clean_input
from awardtrace.sources.tables import read_grants, staging_root, write_grants, write_input

FUNDER = "https://funders.example/F1"

GRANTS_RAW = """
SELECT concat('https://works.example/W', CAST(o_orderkey AS VARCHAR(20))) AS work_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE concat(' 10.5555/ORD.', CAST(o_orderkey - o_orderkey % 2 AS VARCHAR(20)), ' ') END AS doi,
  'grants' AS field_name,
  concat('grants.', CAST(o_orderkey % 3 AS VARCHAR(20))) AS subfield_path,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL
       WHEN o_orderkey % 211 = 0 THEN '{"funder":"https://funders.example/F1","award_id":"DMS-0000001"} trailing'
       WHEN o_orderkey % 223 = 0 THEN concat('{', chr(39), 'funder', chr(39), ':', chr(39), 'https://funders.example/F1', chr(39), '}')
       WHEN o_orderkey % 227 = 0 THEN '{"funder":"https://funders.example/F1","award_id":"DMS-00'
       WHEN o_orderkey % 229 = 0 THEN '{"funder":"https://funders.example/F1","funder":"https://funders.example/F2","award_id":"DMS-0000002"}'
       WHEN o_orderkey % 13 = 0 THEN concat('{"funder":"https://funders.example/F', CAST(o_orderkey % 5 AS VARCHAR(20)), '","award_id":null}')
       ELSE concat('{"funder":"https://funders.example/F', CAST(o_custkey % 5 AS VARCHAR(20)), '","award_id":"',
         CASE o_orderkey % 7
           WHEN 0 THEN concat('DMS-', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'))
           WHEN 1 THEN concat('EP/K', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '/1')
           WHEN 2 THEN concat('R01 GM', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '-05')
           WHEN 3 THEN concat('X/2019/7/', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '/Z')
           WHEN 4 THEN concat('Doctoral Programme/Research Council/', lpad(CAST(o_custkey AS VARCHAR(20)), 10, '0'))
           WHEN 5 THEN 'Doctoral Programme/Research Council'
           ELSE lpad(CAST(o_custkey AS VARCHAR(20)), 8, '0') END, '"}') END AS value,
  concat('S', CAST(o_orderkey % 50 AS VARCHAR(20))) AS source_id,
  '10.5555' AS doi_prefix,
  concat('part_', CAST(o_orderkey % 8 AS VARCHAR(20)), '.gz') AS source_file_path
FROM orders
"""

INPUT_RAW = """
SELECT CASE WHEN l_orderkey % 11 = 0 THEN CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'nan' END
            WHEN l_orderkey % 23 = 0 THEN concat('10.5555/other.', CAST(l_orderkey AS VARCHAR(20)))
            ELSE concat(' 10.5555/Ord.', CAST(l_orderkey - l_orderkey % 2 AS VARCHAR(20)), ' ') END AS doi,
  CASE (l_linenumber + l_orderkey) % 10
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('DMS-', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'))
    WHEN 2 THEN concat('DMS', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'))
    WHEN 3 THEN concat('EP-K', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '/01')
    WHEN 4 THEN concat('5R01GM', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'))
    WHEN 5 THEN concat('R01-GN', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '-05')
    WHEN 6 THEN concat('X/2018/8/', lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0'), '/Z')
    WHEN 7 THEN concat('Doctorat Programms/Research Council/', lpad(CAST(o_custkey AS VARCHAR(20)), 10, '0'))
    WHEN 8 THEN 'Doctorat Programms/Research Council'
    ELSE lpad(CAST(o_custkey + 1 AS VARCHAR(20)), 8, '0') END AS award_id,
  l_returnflag AS programme
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# A list of all funders; its last column is called "list no.", with a blank and a dot, on both sides.
LISTED_RAW = INPUT_RAW.replace("AS programme", """AS programme,
  CASE WHEN l_linenumber = 6 THEN NULL
       ELSE concat('https://funders.example/F', CAST((o_custkey + CAST(l_linenumber = 5 AS INT)) % 6 AS VARCHAR(20))) END AS funder,
  concat('n', CAST(l_linenumber % 2 AS VARCHAR(20))) AS list_no""")


def _from_tables(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem")}
    for name, df in tables.items():
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    used = {name: df for name, df in tables.items() if f"{{{name}}}" in text}
    return spark.sql(_braces_escaped(text, used), **used)


def _braces_escaped(text: str, tables: dict[str, DataFrame]) -> str:
    """Double the braces of JSON literals, as the text goes through a formatter."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return text


def grants_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_tables(spark, sf_dir, GRANTS_RAW)


def input_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_tables(spark, sf_dir, INPUT_RAW)


def listed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_tables(spark, sf_dir, LISTED_RAW).withColumnRenamed("list_no", "list no.")


# What queries start from: the tables a build leaves, each made once per session, when a query first asks for it.
_BUILT: dict[tuple[str, str, str], str] = {}


def _make(spark: SparkSession, sf_dir: str, table: str, path: str) -> None:
    if table == "grants":
        write_grants(clean_grants(grants_raw(spark, sf_dir)), path)
    else:
        raw = {"input": input_raw, "listed": listed_raw}[table](spark, sf_dir)
        write_input(clean_input(raw), path, spread=False)  # the join has dealt the rows already


def _built(spark: SparkSession, sf_dir: str, table: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _BUILT:
        path = f"{staging_root(spark)}/build-{uuid.uuid4().hex}/{table}"  # beyond any scope
        _make(spark, sf_dir, table, path)
        _BUILT[key] = path
    return _BUILT[key]


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_grants(spark, _built(spark, sf_dir, "grants"))


def funder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_built(spark, sf_dir, "input"))


def all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_built(spark, sf_dir, "listed"))
