from __future__ import annotations

import itertools
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from awardtrace.llm.secret_scans import COPIED_OWNERS, FORMS, candidates, scan
from awardtrace.llm.spans import before
from tests.llm.cases import documents, empty, texts

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
HASH = "0123456789abcdef0123456789abcdef"
OWN = "ghp_" + "Ab1" * 12
COPIED = "AIza" + "Zz9" * 11
ROWS = texts() + [
    (400, f'token = "{HASH}" and 😀 Token: abcdefghijkl'), (401, "password: token: abcdefghijklmnop"),
    (402, "AKIA AKIAABCDEFGHIJ1234 AKIAshort xAKIAABCDEFGHIJ12345"), (403, "abc " * 3000 + HASH + HASH[:15]),
    (404, f"😀 key {OWN}"), (405, f"{COPIED} x"), (406, f"y {COPIED}"), (407, f"z {COPIED}"), (408, f"{COPIED}"),
    (409, f"API_KEY='{OWN}'"), (410, "a_long_word_without_digits_at_all")]


def _base(text):
    found = [(m.start(), 1, m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 2, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 3, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_against_brute_force(spark):
    want = defaultdict(list)
    for k, t in ROWS:
        want[k].append([x[:4] for x in _base(t or "")])
    got = scan(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        base = [tuple(s)[:4] for s in r.base]
        assert base in want[r.doc_id]
        assert set(base) <= {tuple(s)[:4] for s in r.spans}


def test_copied_values_are_no_secrets(spark):
    got = {r.doc_id: r for r in scan(documents(spark, ROWS)).collect()}
    owners = {r.source for r in documents(spark, ROWS).where("text LIKE '%AIza%'").collect()}
    assert len(owners) >= COPIED_OWNERS
    for k in (405, 406, 407, 408):
        assert not got[k].spans and got[k].n_copied == 1 and got[k].n_live == 0
    assert [s.kind for s in got[404].spans] == ["github"] and got[404].n_live == 1
    assert got[404].spans[0].start == 6
    assert [s.kind for s in got[409].spans] == ["assign"]  # the value inside is not told twice
    assert not got[410].spans


def test_empty_table(spark):
    assert scan(empty(spark)).count() == 0


def test_one_owner_in_many_repositories(spark):
    rows = [(i, f"k {COPIED}", "web", f"repo{i}") for i in range(6)] + [(i, f"k {OWN}", "web", "repo0") for i in (6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for limit, live in ((7, range(8)), (3, (6, 7))):
        got = {r.doc_id: r for r in scan(docs, copied_repositories=limit).collect()}
        assert [k for k in sorted(got) if got[k].n_live == 1 and len(got[k].spans) == 1] == list(live)
        assert all(got[k].n_live + got[k].n_copied == 1 for k in got)
        assert [(h.owners, h.repositories) for h in got[0].holders] == [(1, 6)]
        assert [(h.owners, h.repositories) for h in got[6].holders] == [(1, 1)]
    assert scan(docs).where("n_live = 1").count() == 2  # as the query has it


def test_very_many_matches_in_one_text(spark):
    """Time in proportion to the matches: base ones, others, and both mixed."""
    draw = random.Random(8)
    mixed = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Qr9"
    words = [("%016x" % draw.getrandbits(64), f"token={i:012d}", mixed + str(i), "plain")[i % 4] for i in range(120_000)]
    rows = [(1, " ".join("%016x" % draw.getrandbits(64) for _ in range(100_000))), (2, " ".join(words)), (3, "token=" + mixed)]
    begin = time.time()
    got = {r.doc_id: r for r in scan(documents(spark, rows)).collect()}
    assert time.time() - begin < 60
    for k, text in rows:
        assert [tuple(s)[:4] for s in got[k].base] == [x[:4] for x in _base(text)]
    assert len(got[1].base) == 100_000 and len(got[2].base) == 60_000
    assert [(s.start, s.end) for s in got[2].spans if s.kind == "opaque"] == [
        m.span() for m in re.finditer("Ab1[A-Za-z0-9]+", rows[1][1])]


def test_overlap_with_base_spans_against_all_pairs(spark):
    """Other spans fall away if they share a character with any base span."""
    draw = random.Random(4)
    parts = ["token=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2", " ", "/", "ghp_", "x"]
    rows = [(i, "".join(draw.choices(parts, k=draw.randrange(1, 14)))) for i in range(400)]
    docs = documents(spark, rows)
    for r in candidates(docs, "text", "doc_id", "source", "lang").select("_key", "base", "extra").collect():
        text, base = dict(rows)[r._key], [(s.start, s.end) for s in r.base]
        forms = []
        for m in re.finditer("|".join(FORMS.values()), text):
            kind = next((k for k, form in FORMS.items() if k != "opaque" and re.fullmatch(form, m[0])), "opaque")
            varied = all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and len(set(m[0])) >= 10
            if (kind != "opaque" or varied) and not any(a < m.end() and m.start() < b for a, b in base):
                forms.append((*m.span(), kind))
        assert [(s.start, s.end, s.kind) for s in r.extra] == forms


def test_running_results_over_blocks(spark):
    draw = random.Random(6)
    rows = [([draw.randrange(-5, 50) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 127, 4095, 4096, 4097, 300_000)]
    df = spark.createDataFrame(rows, "own array<int>").select(
        "own", before(F.col("own"), 0, lambda a, b: a + b).alias("sums"), before(F.col("own"), -1, F.greatest).alias("most"))
    for own, sums, most in df.collect():
        assert sums == list(itertools.accumulate(own, initial=0))[:len(own)]
        assert most == list(itertools.accumulate(own, max, initial=-1))[:len(own)]
