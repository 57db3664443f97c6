"""Every query with SQL against that SQL, on the smallest driver tables; the others run."""

from __future__ import annotations

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
from awardtrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert entry.queries()[name] is QUERIES[name]
    df = QUERIES[name](spark, SF)
    got = _plain([tuple(r) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    if name not in ORACLES:
        count = con.execute("SELECT count(*) FROM documents").fetchone()[0]
        rows = {r[sorted(df.columns).index("doc_id")] for r in got} if name.startswith("op12") else got
        assert len(rows) == count
        return
    want = con.execute(ORACLES[name])
    assert got == _plain(want.fetchall(), [d[0] for d in want.description])


def test_operators_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()
