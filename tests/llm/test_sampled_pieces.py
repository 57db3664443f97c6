from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from awardtrace.llm import sampled_pieces as sp
from awardtrace.llm.sampled_pieces import decode, default_path, encode, vocabulary, with_pieces
from tests.llm.cases import SCHEMA, documents, empty


@pytest.fixture(scope="module")
def v():
    return vocabulary(default_path())


def test_round_trip_of_any_text(v):
    texts = ["Hello  the\nworld é ▁x 梦 😀\0 \t\r\n  ", "", "a", " ", "\n\n", "x" * 999, "▁▁ ▁", "<s></s><unk><0x0A>", "ö" * 300 + " " * 50]
    ids = encode(texts, [str(i) for i in range(len(texts))], v)
    assert [decode(i, v) for i in ids] == texts
    assert all(np.isfinite(v.weights[i]).all() for i in ids)  # no control piece


def test_draws_follow_the_weights(v):
    """Frequencies of whole segmentations against their enumeration."""
    usable = {p: i for i, p in enumerate(v.pieces) if i > 258 and np.isfinite(v.weights[i])}

    def ways(rest: bytes):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in usable:
                for tail, weight in ways(rest[k:]):
                    yield (usable[rest[:k]], *tail), v.weights[usable[rest[:k]]] + weight

    n = 20_000
    for word in ("hello", " then"):
        want = dict(ways(word.encode()))
        total = np.logaddexp.reduce(list(want.values()))
        got = Counter(tuple(i.tolist()) for i in encode([word] * n, [f"k{i}" for i in range(n)], v))
        assert set(got) <= set(want) and len(got) > 3
        assert max(abs(got[k] / n - np.exp(w - total)) for k, w in want.items()) < 0.015


def test_rows_keep_their_cut(spark):
    docs = documents(spark)
    row = F.struct("row.doc_id", F.xxhash64("row.text"), "pieces")
    runs = [sorted(map(str, with_pieces(d).select(row).collect())) for d in (docs, docs.repartition(5).orderBy("n_chars"))]
    assert runs[0] == runs[1]
    got = with_pieces(docs)
    assert got.select("row.*").schema.fieldNames() == SCHEMA.fieldNames()
    assert got.where(F.col("decoded") != F.coalesce("row.text", F.lit(""))).count() == 0
    cuts = {r.doc_id: r.pieces for r in got.where("row.doc_id IN (5, 6)").select("row.doc_id", "pieces").collect()}
    assert cuts[5] != cuts[6]  # equal texts, other keys
    assert with_pieces(empty(spark)).count() == 0


def test_lattices_take_little_memory_at_once(monkeypatch):
    """Two million characters of ever new words; cut alike however many units a block of lattices has."""
    import tracemalloc

    v = sp.vocabulary(sp.default_path())
    texts = pd.Series([" ".join(f"w{n * 97 % 7919}x{n}" for n in range(i, i + 500)) for i in range(0, 160_000, 500)])
    tracemalloc.start()
    try:
        for part in sp._batches(texts):
            sp.encode(texts.iloc[part].tolist(), ["k"] * len(texts.iloc[part]), v)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    some = texts.iloc[:5].tolist()
    blocks = sp.encode(some, ["k"] * 5, v)
    monkeypatch.setattr(sp, "LATTICE_BYTES", 10 ** 9)
    assert all((a == b).all() for a, b in zip(blocks, sp.encode(some, ["k"] * 5, v)))
