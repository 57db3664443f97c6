from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import awardtrace.llm.turn_repair as repair

COLUMNS = "conv_id long, turn long, role string, text string, _conv string, audit int, `a.b` string"
NAMES = {2: "user", 3: "assistant"}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def _damaged(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def _best(own):
    """All ways forward, the cheapest and least of each state kept: cost, audit, turns."""
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    counts, seen, ways = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), {0: (0, "", [])}

    def put(ways, q, way):
        if q not in ways or way[:2] < ways[q][:2]:
            ways[q] = way

    def inserted(ways):
        for _ in range(4):
            for q, (cost, audit, turns) in list(ways.items()):
                put(ways, NEXT[q], (cost + 2, audit + "I", turns + [(NAMES[NEXT[q]], "")]))
        return ways

    ways = inserted(ways)
    for _, role, text in own:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}
        for q, (cost, audit, turns) in ways.items():
            put(after, q, (cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            if (role[:1], q) in KEPT:
                put(after, KEPT[role[:1], q], (cost + late, audit + "K", turns + [(role, text)]))
            put(after, NEXT[q], (cost + 2 + late, audit + "R", turns + [(NAMES[NEXT[q]], text)]))
        ways = inserted(after)
    turns = [t for t, _, _ in own if t is not None]
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = min((ways[q] for q in (0, 3) if q in ways), key=lambda w: w[:2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, best[0], best[1]), best[2]


def _expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in _damaged(rows):
        by[conv].append((turn, role, text))
    return {conv: _best(own) for conv, own in by.items()}


def _rows():
    draw = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "User", "tool", "", None, "a"]
    texts = ["Fine.", "Well", "Really?", "", " \n", None, "ends so!  ", "one two\x1f", "Ünï 😀", "x" * 50_000 + "."]
    rows = []
    for conv in [None, -3, 2 ** 60 + 1, *range(40)]:
        for turn in range(draw.choice([0, 1, 2, 5, 9, 14]) + 1):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 7, turn // 2, None, 2 ** 61 + turn]),
                         draw.choice(roles), draw.choice(texts)))
    rows += rows[:5] + [(7, 3, "user", "same text")] * 60 + [(8, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(70)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_against_brute_force(spark, monkeypatch, block):
    """With small blocks most conversations go over several of them."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = _rows()
    want = _expected(rows)
    got = {r[0]: tuple(r[1:]) for r in repair.reports(_frame(spark, rows), damage=True).collect()}
    digest = lambda turns: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    assert got == {conv: (*report, digest(turns)) for conv, (report, turns) in want.items()}
    assert any("I" in report[6] and "R" in report[6] for report, _ in want.values())


def test_turns_without_damage(spark):
    rows = _rows()
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {}
    for r in repair.repaired(_frame(spark, rows)).orderBy("place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {conv: turns for conv, own in by.items() if (turns := _best(own)[1])}


def test_rows_that_are_all_dropped_and_no_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair.reports(_frame(spark, [(1, gone, "user", "a.")]), damage=True).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.reports(_frame(spark, [])).count() == 0


def test_sql_on_the_same_rows(spark):
    import pandas as pd

    rows = [r for r in _rows() if r[1] is None or r[1] < 2 ** 60]
    frame = pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], dtype="Int64"), "turn": pd.array([r[1] for r in rows], dtype="Int64"),
                          "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    con = duckdb.connect()
    con.register("conversations", frame)
    want = {r[0]: r[1:-1] for r in con.execute(repair.OP11_SQL).fetchall()}
    assert want == {conv: report for conv, (report, _) in _expected(rows).items()}


def test_least_ways_through_doubled_pointers():
    """Drawn graphs whose arcs out of a node differ in their letter, against a walk letter by letter."""
    draw = random.Random(1)
    for _ in range(200):
        nodes = draw.randrange(1, 30)
        arcs = {(v, draw.randrange(4)): draw.randrange(v + 1, nodes) for v in range(nodes - 1) for _ in range(draw.randrange(4))}
        tail, letter, head = (np.array(c, dtype=np.int64) for c in
                              ([v for v, _ in arcs], [x for _, x in arcs], list(arcs.values())))
        words, ends = repair.least_ways(tail, letter, head, np.arange(nodes), nodes)
        for v in range(nodes):
            at, word = v, ""
            while own := [x for u, x in arcs if u == at]:
                word, at = word + "DIKR"[min(own)], arcs[at, min(own)]
            assert words[v] == word and ends[v] == (at if word else -1)
