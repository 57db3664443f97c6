"""Every query against its SQL on the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert entry.queries()[name] is QUERIES[name] and name in entry.oracle_sql()
    assert compare(spark, con, name, SF) == []


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "doi", "programme", "funder_award_id", "corpus_award_id", "work_id", "match_type", "similarity_score"
    ]
    assert df.count() > 0
