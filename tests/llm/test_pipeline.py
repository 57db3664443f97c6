"""The whole pipeline on a small table against plain Python, each stage on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from awardtrace.llm.common import stage
from awardtrace.sources import tables
from tests.llm.cases import SCHEMA, documents, empty, texts
from tests.llm.test_exact_dedup import _norm
from tests.llm.test_ngram_join import _brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = corpus_pipeline.documents(spark, SF), []
    for _, function in corpus_pipeline.STAGES:
        out.append(docs := stage(function(spark, docs, SF), "test-stage"))
    return [corpus_pipeline.documents(spark, SF), *out]


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_order(steps):
    assert [s.columns for s in steps[:5]] == [COLUMNS] * 5
    assert steps[5].columns == [*COLUMNS, "pieces", "lossless"]
    assert set(rows(steps[1])) <= set(rows(steps[0])) and steps[1].count() >= 0.8 * steps[0].count()


def test_exact_and_near_copies(steps):
    best = {}
    for k, t in rows(steps[1]):
        best[_norm(t)] = min(best.get(_norm(t), (1,)), (-len(t or ""), k))
    assert sorted(k for k, _ in rows(steps[2])) == sorted(k for _, k in best.values())
    assert sorted(k for k, _ in rows(steps[3])) == sorted({c for _, _, c in _brute(rows(steps[2]), 5, 80, 100)})


def test_mix_and_pieces(steps):
    words = lambda df: Counter({s: sum(len((r.text or "").split()) for r in df.collect() if r.source == s)
                                for s in {r.source for r in df.collect()}})
    before, after = words(steps[3]), words(steps[4])
    assert max(Counter(rows(steps[4])).values()) <= 2 and set(rows(steps[4])) <= set(rows(steps[3]))
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) < 0.25 * sum(before.values())
    got = steps[5].collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows(steps[4]))
    assert all(r.lossless and (len(r.pieces) > 0) == bool(r.text) for r in got)


def _folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(5, 0), (100, 0), (101, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_edge_cases(spark, tmp_path, monkeypatch):
    """Nulls, empty and very long texts, repeated rows and keys, names that the stages use themselves; nothing stays behind."""
    root = tmp_path / "staging"
    monkeypatch.setattr(tables, "staging_root", lambda _: str(root))
    docs = documents(spark).withColumnsRenamed({"kept": "pieces", "size": "Lossless"})
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path, docs))
    assert got.columns == [*docs.columns, "pieces_", "lossless_"]
    rows = got.collect()
    assert all(r.lossless_ for r in rows) and {r.pieces for r in rows} == {"k"}
    assert len(list(root.iterdir())) == 1  # the last stage's result
    # Toxicity has one class only, so all stay; then one of equal texts, then one of each group of near copies.
    best = {}
    for k, t in texts():
        best[_norm(t)] = min(best.get(_norm(t), (1,)), (-len(t or ""), k is None, k or 0, k))
    kept = [(k, next(t for x, t in texts() if x == k and _norm(t) == n and -len(t or "") == c)) for n, (c, _, _, k) in best.items()]
    left = {c for k, _, c in _brute(kept, 5, 80, 100)}
    assert {r.doc_id for r in rows} <= left and {r.doc_id for r in rows} >= {4, 9, 13} & left


def test_no_documents(spark, tmp_path):
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path, empty(spark)))
    assert got.columns == [*SCHEMA.fieldNames(), "pieces", "lossless"] and got.count() == 0
