from __future__ import annotations

import math
import random

import numpy as np
import pytest

import awardtrace.llm.hard_negatives as mining

COLUMNS = "vec_id long, embedding array<float>, label int, block long, score string, `a.b` string"


def _brute(rows, every=100):
    fit = [(k, lab, [math.floor(256.0 * x) for x in v]) for k, v, lab in rows
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda k: math.inf if k is None else k
    found = []
    for i, (anchor, label, own) in enumerate(fit):
        if anchor is None or anchor % every:
            continue
        clip = lambda n: max(-2 ** 63, min(2 ** 63 - 1, n))
        scored = [(clip(sum(a * b for a, b in zip(own, v))), k, lab) for j, (k, lab, v) in enumerate(fit) if j != i]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for top, positive, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 80 * top <= 100 * s[0] <= 100 * top][:5]
            found += [(anchor, positive, n, k, top, score) for n, (score, k, _) in enumerate(window, 1)]
    return sorted(found, key=repr)


def _rows():
    draw = random.Random(5)
    vector = lambda: [float(np.float32(draw.uniform(-0.2, 1))) for _ in range(6)]
    rows = [(k, vector(), draw.randrange(3)) for k in range(0, 900, 3)]
    same = vector()
    rows += [(k, same, 1) for k in range(1000, 1150)] + [(k, same, 2) for k in range(1150, 1300)]  # ties, many copies
    rows += [(1100, same, 1)] * 3 + [(100, same, 0)] * 2 + [(None, vector(), 0), (None, same, 1), (200, None, 1), (300, vector(), None)]
    rows += [(400, [math.nan] * 6, 1), (500, [1.0, None, 1.0], 2), (600, [math.inf], 0), (700, [], 1), (800, [1.0], 1)]
    rows += [(-100, vector(), 1), (2 ** 60, vector(), 0), (1300, [0.0] * 6, 1), (1400, [-x for x in same], 2)]
    return rows


def _mined(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS).repartition(5)
    return sorted((tuple(r) for r in mining.mine(docs).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(8192, 4096, 256), (16, 3, 2)])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Small blocks deal every anchor's rows over many of them."""
    for name, size in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "AT_ONCE"), sizes):
        monkeypatch.setattr(mining, name, size)
    rows = _rows()
    assert _mined(spark, rows) == _brute(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [1e15, 3.0, 0.1], 0), (1, [1e15, 2.0, 0.1], 0), (2, [1e15, 1.0, 0.2], 1), (3, [0.9e15, 7.0, 0.0], 1),
            (4, [-1e15, 0.0, 0.0], 1), (5, [5.0, 1e9, 3.0], 0), (6, [5.0, 1e9, 2.0], 1), (100, [3.0, 1e9, 1.0], 0)]
    assert _mined(spark, rows) == _brute(rows)


def test_no_rows_no_anchors_no_partners(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert _mined(spark, [(100, [1.0], 0), (2, [1.0], 1)]) == []


def test_best_of_large_scores():
    big = 2 ** 62
    score = np.array([[big, -big, big - 1, big, 5, 6, 7, 8]])
    r, c = mining._best(score, np.array([[True, True, True, True, False, True, True, True]]), 3)
    assert sorted(c.tolist()) == [0, 2, 3] and set(r.tolist()) == {0}
