from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from awardtrace.llm import exact_dedup
from tests.llm.cases import SCHEMA, documents, empty, texts


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_groups_against_brute_force(spark):
    rows = texts()
    groups = defaultdict(list)
    for k, t in rows:
        groups[_norm(t)].append((-len(t or ""), k is None, k or 0, k))
    got = exact_dedup.sorted_copies(documents(spark)).select(
        "row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(rows)
    for r in got:
        group = groups[_norm(r.text)]
        assert r.text_sha256 == hashlib.sha256(_norm(r.text).encode()).hexdigest()
        assert (r.group_size, r.keep_id) == (len(group), min(group)[3])
    assert sum(r.kept for r in got) == len(groups)  # exactly one of each, also of repeated rows
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_texts_and_starts_give_the_same(spark, monkeypatch):
    order = ["row.doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    key = lambda r: tuple(map(str, r))
    rows = [(i, t) for i, t in enumerate([("common start " * 8) + str(i % 40) for i in range(400)] + ["hot  text"] * 300)]
    docs = documents(spark, rows)
    starts, hot = exact_dedup._hot(docs.selectExpr("text AS _text"))
    assert len(starts) == 2 and len(hot) >= 1
    with_salts = sorted(map(key, exact_dedup.sorted_copies(docs).select(*order).collect()))
    monkeypatch.setattr(exact_dedup, "_hot", lambda texts: ([], {}))
    assert sorted(map(key, exact_dedup.sorted_copies(docs).select(*order).collect())) == with_salts


def test_dedup_keeps_columns_and_empty_tables(spark):
    kept = exact_dedup.dedup(documents(spark))
    assert kept.schema.fieldNames() == SCHEMA.fieldNames()
    assert exact_dedup.dedup(empty(spark)).count() == 0
    assert exact_dedup.sorted_copies(empty(spark)).count() == 0


def test_salts_grow_with_share_and_partitions(spark):
    assert exact_dedup._salts({"a": 0.5, "b": 0.002}, 200) == {"a": 200, "b": 1}
    rows = [(1, "the one text")] * 900 + [(i, f"other {i}") for i in range(300)]  # alike in the key too
    docs = documents(spark, rows)
    _, hot = exact_dedup._hot(docs.selectExpr("text AS _text"))
    assert [round(s, 2) for s in hot.values()] == [0.75]
    got = exact_dedup.sorted_copies(docs).groupBy("group_size").agg({"kept": "max", "*": "count"}).collect()
    assert sorted((r.group_size, r["count(1)"]) for r in got) == [(1, 300), (900, 900)]
    assert exact_dedup.sorted_copies(docs).where("kept AND group_size = 900").count() == 1
