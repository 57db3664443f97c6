from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from awardtrace.llm.quality import MOST_IN_NGRAMS, rated
from tests.llm.cases import documents, empty, texts

SPACE = " \t\n\x0b\x0c\r"


def _brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(f"[{SPACE}]+", text) if w]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    out["n_dup_lines"] = sum(line in lines[:i] for i, line in enumerate(lines))
    dup = sum(len("".join(line.split())) for i, line in enumerate(lines) if line in lines[:i])
    out["dup_line_chars"] = dup / out["word_chars"] if words else 0.0
    for n in MOST_IN_NGRAMS:
        seen = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        inside = {k for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for k in range(i, i + n)}
        out[f"dup_chars_{n}"] = sum(len(words[k]) for k in inside) / out["word_chars"] if words else 0.0
        if n == 5:
            out["n_repeat_words"] = len(inside)
    return out


def test_measures_against_brute_force(spark):
    rows = texts() + [(500, "a b c d e " * 9 + "#|$"), (501, "x y z " * 40), (502, "l\n" * 30)]
    want = defaultdict(list)
    for k, t in rows:
        want[k].append(_brute(t))
    got = rated(documents(spark, rows)).select("row.doc_id", "*").drop("row").collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(all(r[c] == pytest.approx(v) for c, v in w.items()) for w in want[r.doc_id]), r
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_clean_prose_stays_and_repetition_goes(spark):
    got = {r.doc_id: r.kept for r in rated(documents(spark)).select("row.doc_id", "kept").collect()}
    assert got[4] and got[5] and got[100] and not got[14] and not got[12] and not got[1] and not got[9]


def test_empty_table(spark):
    assert rated(empty(spark)).count() == 0
