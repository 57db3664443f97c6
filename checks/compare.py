"""Run queries side by side in Spark and DuckDB: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from awardtrace.sources.tables import clear_staging
from checks.oracles import ORACLES
from checks.registry import QUERIES

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """What differs between the Spark query and its SQL; empty if nothing does."""
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    columns = {d[0]: str(d[1]) for d in want.description}
    problems = []
    if set(df.columns) != set(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for column, kind in df.dtypes:
        if TYPES.get(kind) != columns[column]:
            problems.append(f"type of {column}: {kind} != {columns[column]}")
    expected = _rows(want.fetchall(), list(columns))
    got = _rows((tuple(r) for r in df.collect()), df.columns)
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if got != expected:
        a, b = set(got), set(expected)
        problems.append(f"values: spark only {list(a - b)[:3]}, sql only {list(b - a)[:3]}")
    return problems


if __name__ == "__main__":
    from checks.session import local_session

    spark, con = local_session(), connect(sys.argv[1])
    for key in sys.argv[2:] or QUERIES:
        begin = time.time()
        try:
            found = compare(spark, con, key, sys.argv[1])
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'FAIL' if found else 'ok  '} {key} {time.time() - begin:.1f}s", *found, flush=True)
    clear_staging(spark)
