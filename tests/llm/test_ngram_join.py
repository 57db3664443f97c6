from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from awardtrace.llm import ngram_join
from awardtrace.llm.components import components
from awardtrace.llm.signature_tree import Classes, bitmap, walk, width_for
from tests.llm.cases import SCHEMA, documents, empty, prose, texts


def _sets(rows, n):
    out = []
    for k, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        m = min(n, len(w))
        out.append((k, frozenset(tuple(w[i:i + m]) for i in range(len(w) - m + 1)) if w else frozenset()))
    return out


def _brute(rows, n, num, den):
    """Every pair of sets, then everything that links reach."""
    sets = [(k, s) for k, s in _sets(rows, n)]
    label = list(range(len(sets)))
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is None or b is None or not s or not t:
                continue
            shared = len(s & t)
            if den * shared >= num * (len(s) + len(t) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (k, _), x in zip(sets, label):
        if k is not None:
            least[x].append(k)
    return sorted(((k, len(s), min(least[x]) if k is not None and s else k) for (k, s), x in zip(sets, label)), key=str)


def near_copies(seed: int, count: int, words: int, edits: int) -> list[str]:
    draw, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(len(own))] = f"edit{draw.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def rows_with_near_copies():
    found = [t for s, n, w, e in ((1, 60, 90, 8), (2, 25, 30, 3), (3, 30, 400, 40), (4, 20, 12, 2)) for t in near_copies(s, n, w, e)]
    passage = prose(77, 60)
    found += [passage + " " + prose(500 + i, 12) for i in range(40)]
    return texts() + [(1000 + i, t) for i, t in enumerate(found)]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
@pytest.mark.parametrize("run, blocks", [(1024, 256), (20, 15), (20, 3)])
def test_against_all_pairs(spark, monkeypatch, n, num, run, blocks):
    monkeypatch.setattr(ngram_join, "RUN", run)  # few sets under a shingle, small blocks: the ways for large groups
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    rows = rows_with_near_copies()
    got = ngram_join.linked(documents(spark, rows), n, num, 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows, n, num, 100)


def test_one_of_each(spark):
    rows = rows_with_near_copies()
    kept = ngram_join.one_of_each(documents(spark, rows))
    assert kept.schema.fieldNames() == SCHEMA.fieldNames()
    want = {c for k, _, c in _brute(rows, 5, 80, 100) if k is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert ngram_join.linked(empty(spark)).count() == 0 and ngram_join.one_of_each(empty(spark)).count() == 0


def test_walk_finds_all_classes_with_few_checks():
    draw = np.random.default_rng(1)
    sets = []
    for size in (30, 200):
        for _ in range(20):
            base = draw.integers(0, 1 << 62, size, dtype=np.uint64)
            for _ in range(15):
                own = base.copy()
                own[draw.integers(0, size, draw.integers(0, 3))] = draw.integers(0, 1 << 62)
                sets.append(np.unique(own))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    maps = np.stack([bitmap(s, width_for(2 * int(sizes[-1]))) for s in sets])
    checks = 0

    def check(i, js):
        nonlocal checks
        checks += len(js)
        shared = np.array([len(np.intersect1d(sets[i], sets[j])) for j in js])
        return 100 * shared >= 90 * (sizes[i] + sizes[js] - shared)

    classes, want = Classes(len(sets)), Classes(len(sets))
    walk(sizes, maps, 90, 100, classes, check)
    real = checks
    for i in range(len(sets)):
        for j in np.flatnonzero(check(i, np.arange(len(sets)))):
            want.join(i, int(j))
    same = lambda c: c.label[:, None] == c.label
    assert (same(classes) == same(want)).all() and real < len(sets) * 15


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 300), (300, 300)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {-5: -5, 300: -5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("run, blocks", [(1024, 256), (20, 15)])
def test_links_against_all_pairs(spark, monkeypatch, run, blocks):
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    rows = rows_with_near_copies()
    rows += [(2000, rows[-1][1] + " tail"), (2000, rows[-1][1] + " other tail"), (2000, rows[-1][1])]  # one key, texts that link
    least = {}
    for k, s in _sets(rows, 3):
        if k is not None and s:
            least[s] = min(k, least.get(s, k))
    want = sorted(sorted((a, b)) for s, a in least.items() for t, b in least.items()
                  if s != t and 100 * len(s & t) >= 90 * len(s | t))
    got = ngram_join.links(documents(spark, rows), 3, 90, 100).collect()
    assert sorted([r.a, r.b] for r in got) == want[::2]  # each pair stands there both ways
    assert all((r.a, bytes(r.a_set)) < (r.b, bytes(r.b_set)) for r in got) and any(r.a == r.b == 2000 for r in got)
    assert len(got) >= len({k for r in got for k in (r.a, r.b)})  # more than a tree of each component has
    assert ngram_join.links(empty(spark)).count() == 0
    # Which rows have which set: with that, every link between rows can be told.
    mine = ngram_join.members(documents(spark, rows), 3).collect()
    assert sorted((r.doc_id, r.n_shingles, r.representative) for r in mine if r.doc_id is not None) == sorted(
        ((k, len(s), least.get(s)) for k, s in _sets(rows, 3) if k is not None), key=lambda x: (x[0], x[1], x[2] or 0))
    sets = {(r.representative, bytes(r.set)) for r in mine}
    assert all((r.a, bytes(r.a_set)) in sets and (r.b, bytes(r.b_set)) in sets for r in got)


def test_texts_of_a_large_class_are_dealt_in_proportion(spark, monkeypatch):
    """Twice as many near copies in a class of many blocks take some twice as many rows of text, not four times."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    dealt = []
    texts_of = ngram_join._texts
    monkeypatch.setattr(ngram_join, "_texts", lambda docs, members, *a: (out := texts_of(docs, members, *a), dealt.append(out.count()))[0])
    counts = []
    for copies in (150, 300):
        dealt.clear()
        rows = list(enumerate(near_copies(5, copies, 200, 4)))
        got = ngram_join.linked(documents(spark, rows), 3, 90, 100).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute(rows, 3, 90, 100)
        assert len({r.component_id for r in got}) < copies / 3
        counts.append(sum(dealt))
    assert counts[1] < 3 * counts[0] and counts[1] < 6 * 300, counts


def test_long_runs_are_kept_whole(monkeypatch):
    """Whatever the batches and the buffer, no set with a partner of a fitting size under its shingle is left out."""
    import pandas as pd

    draw = random.Random(3)
    rows = sorted((draw.choice([1, 2, 2, 2, 3, 4, 4]), draw.randrange(1, 60), i) for i in range(400))
    df = pd.DataFrame(rows, columns=["token", "n", "sid"])
    for size, buffer in ((7, 1000), (400, 1000), (7, 20), (33, 50)):
        monkeypatch.setattr(ngram_join, "_BUFFER", buffer)
        parts = [df.iloc[a:a + size].reset_index(drop=True) for a in range(0, len(df), size)]
        kept = pd.concat(list(ngram_join._met(90, 100)(iter(parts))))
        assert len(kept) == kept["sid"].nunique()
        for t, n, i in rows:
            if any(t == u and i != j and 100 * min(n, m) >= 90 * max(n, m) for u, m, j in rows):
                assert i in set(kept["sid"])
        assert set(df["sid"][df["token"].isin([1, 4])]) <= set(kept["sid"])  # they may go on in other tasks


def test_sets_of_many_texts_at_once(monkeypatch):
    """The same words in a row have one hash in every text and block, other words another one."""
    import pyarrow as pa

    from awardtrace.llm import shingles

    monkeypatch.setattr(shingles, "LONG_WORD", 20)
    rows = [t or "" for _, t in texts()] + ["A\x1cB  c", "a\x1cb C", "x" * 20 + " y", "x" * 21 + " y", "X" * 21 + "\ty", "", "lead \v\f trail ",
                                            "12345678 12345678x", "12345678\n12345678X", "É é", "a", "a a a a a", " a b"]
    for n in (1, 3, 5):
        for size in (1, 500, 10_000_000):
            monkeypatch.setattr(shingles, "BLOCK_BYTES", size)
            got = [own for block in shingles.blocks(pa.array(rows)) for own in shingles.shingle_sets(block, n)]
            want = [s for _, s in _sets(enumerate(rows), n)]
            assert [len(g) for g in got] == [len(w) for w in want]
            assert all((np.diff(g) > 0).all() for g in got)
            named = {frozenset(w): g.tobytes() for w, g in zip(want, got)}
            assert all(named[w] == g.tobytes() for w, g in zip(want, got)) and len(set(named.values())) == len(named)
            every = {s for w in want for s in w}
            assert len(np.unique(np.concatenate(got))) == len(every)
    sets = shingles.shingle_sets(pa.array(rows), 3)
    maps = [bitmap(s, width_for(len(s))).tobytes() if len(s) else b"" for s in sets]
    assert sets.bitmaps().to_pylist() == maps


def test_sets_that_cannot_link_do_not_meet():
    """Under a shingle that stands too late in two sets for them to share enough, neither is kept or looked at."""
    import pandas as pd

    rows = [(t, 100, 2 * t + k, pos) for t in range(1, 9) for k, pos in ((0, 0), (1, 3 * (t % 4)))]
    df = pd.DataFrame(rows, columns=["token", "n", "sid", "pos"])
    kept = pd.concat(list(ngram_join._met(90, 100)(iter([df]))))
    # 95 of 100 shingles have to be shared: at place 6 and 9 too few are left. The edges of a task are kept.
    assert sorted(set(kept["token"])) == [1, 4, 5, 8]
    bits = df.assign(bits=[bitmap(np.arange(100, dtype=np.uint64), 128).tobytes()] * len(df))
    ties = pd.concat(list(ngram_join._ties(90, 100)(iter([bits]))))
    assert {(u, v) for u, v in zip(ties["u"], ties["v"]) if v >= 0} == {(8, 9), (10, 11)}
