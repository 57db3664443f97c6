from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import duckdb

from awardtrace.llm import licenses
from awardtrace.llm.licenses import PHRASES, op3_license_scans, rules, scan
from tests.llm.cases import documents, empty, texts

ROWS = texts() + [
    (400, "Licensed under the Apache License, Version 2.0. 😀 All rights\nreserved. No  rights reserved"), (401, "CC-BY cc by Cc/bY; xcc by"),
    (402, "GNU General Public License version 3 and general, public... license"), (403, "SPDX-License-Identifier: MIT\nmit license"),
    (404, "see https://www.gnu.org/licenses/lgpl-2.1.html or the LGPL v2.1"), (405, "made in the open, with permission is hereby given"),
    (406, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (407, "released under CC BY-NC 4.0"),
    (408, "unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
    (409, "word " * 5000 + "copyright (c) 2020-2024"), (410, "allrights reserved; all rights  éreserved"), (411, "0bsd BSD-3-Clause license")]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _brute(text):
    """All rules on all texts, and every detection against every other one."""
    text = _lower(text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    found = {(m.start(), m.end(), label, priority) for _, label, priority, p in rules() for m in re.finditer(p, text, re.A)}
    kept = [s for s in found if not any(
        t != s and t[0] <= s[0] and t[1] >= s[1] and (
            t[3] > s[3] or t[3] == s[3] and (t[:2] != s[:2] or t[2] < s[2]))
        for t in found)]
    return len(words), places, sorted(kept)


def test_against_brute_force(spark):
    want = defaultdict(list)
    for k, t in ROWS:
        want[k].append(_brute(t))
    got = scan(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and len(rules()) > 300
    for r in got:
        mine = (r.n_words, [tuple(p) for p in r.places], sorted(tuple(s) for s in r.found))
        assert mine in want[r.doc_id], r.doc_id
    by_id = {r.doc_id: r for r in got}
    assert [s.label for s in by_id[400].found] == ["apache-2.0", "reserved"]
    assert by_id[403].score == 1.0 and by_id[405].found == [] and len(by_id[401].places) == 3
    assert "lgpl-2.1" in {s.label for s in by_id[404].found}


def test_empty_table(spark):
    assert scan(empty(spark)).count() == 0


GATED = ["Released under MIT No Attribution", "projectLicense: MIT", "Terms of UseCopyright (c) 2021", "xxPermission to use, copy, modify and/or "
         "distribute this software for any purpose", "endPermission is hereby granted, free of charge, to any person obtaining a copy",
         "1Redistribution and use in source and binary forms, with or without modification, are permitted", "subLicence:mpl-2.0",
         "aProprietary and confidential", "bUnauthorised use of it is prohibited"]


def test_gates_let_through_what_rules_match(spark):
    rows = [(i, t) for i, t in enumerate(GATED)]
    for r in scan(documents(spark, rows)).collect():
        assert sorted(tuple(s) for s in r.found) == _brute(GATED[r.doc_id])[2] != [], GATED[r.doc_id]


def _draw(tree, draw):
    """A random text that a parsed pattern matches, but for what its assertions ask of the text around it."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            kind, one = draw.choice(value)
            if str(value[0][0]) == "NEGATE":
                out += "x"
            elif str(kind) == "RANGE":
                out += chr(draw.randint(*one))
            else:
                out += chr(one) if str(kind) == "LITERAL" else draw.choice(" \n")
        elif op == "BRANCH":
            out += _draw(draw.choice(value[1]), draw)
        elif op == "SUBPATTERN":
            out += _draw(value[3], draw)
        elif op == "MAX_REPEAT":
            least, most, inner = value
            out += "".join(_draw(inner, draw) for _ in range(draw.randint(least, min(most, least + 1))))
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_every_rule_passes_both_gates():
    """Texts drawn from each rule, bare and glued to what stands before."""
    draw = random.Random(3)
    gate, words = re.compile(licenses._ANCHOR_GATE, re.A), re.compile(f"(?=({licenses._keyword_pattern()}))", re.A)
    keywords = defaultdict(set)
    for keyword, label, priority, pattern in rules():
        keywords[label, priority, pattern].add(keyword)
    for (_, _, pattern), own in keywords.items():
        rule, tree, matched = re.compile(pattern, re.A), re._parser.parse(pattern), 0
        for k in range(150):
            text = ("", "x", "9", " ")[k % 4] + _draw(tree, draw)
            if not rule.search(text):
                continue
            matched += 1
            held = {re.sub(r"\s", " ", m[1]) for m in words.finditer(text)}
            assert gate.search(text), (pattern, text)
            assert any(o in h for h in held for o in own), (pattern, text)
        assert matched, pattern


def test_very_many_matches_in_one_text(spark):
    """Places and detections of a text with 100,000 of them, in time that grows with their number."""
    unit = "MIT License, all rights reserved; all all Copyright 2021 x "
    rows = [(1, unit * 25_000), (2, "cc by " * 100_000), (3, unit)]
    begin = time.time()
    got = {r.doc_id: r for r in scan(documents(spark, rows)).collect()}
    assert time.time() - begin < 60
    one = [tuple(s) for s in got[3].found]
    assert [tuple(s) for s in got[1].found] == [(a + i * len(unit), b + i * len(unit), *rest) for i in range(25_000) for a, b, *rest in one]
    assert len(got[1].found) == 75_000 and len(got[1].places) == 25_000 and len(got[2].places) == 100_000


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 1] = ['cc', 'by']) AS cc,
         list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['general', 'public', 'license']) AS gpl,
         list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['all', 'rights', 'reserved']) AS kept FROM w)
SELECT doc_id, n_words, len(cc) + len(gpl) + len(kept) AS n_base, list_min(cc || gpl || kept) - 1 AS first_word,
       list_max(cc || gpl || kept) - 1 AS last_word, array_to_string(list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END,
         CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(kept) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels
FROM p
"""


def test_base_columns_against_sql(spark):
    """The columns that do not depend on the method, on a driver table."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(BASE_SQL).fetchall())
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = sorted(tuple(r) for r in op3_license_scans(spark, sf).select(*columns).collect())
    assert got == want and sum(r[2] for r in want) > 10
