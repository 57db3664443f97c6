from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from awardtrace.llm.sharding import ROW_BYTES, TOLERANCE, placed
from tests.llm.cases import documents, empty, texts


def _brute(rows, shards):
    of = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    items = sorted((of(t or "", 8), of("" if k is None else str(k), 7), k is None, k or 0, len((t or "").encode()) + ROW_BYTES)
                   for k, t in rows)
    total = sum(x[4] for x in items)
    groups = defaultdict(list)
    for x in items:
        groups[x[0]].append(x[4])
    below, start, out = 0, {}, []
    for x in items:
        start.setdefault(x[0], below)
        own = groups[x[0]]
        split = len(own) > 1 and sum(own) > total // (shards * TOLERANCE)
        out.append((None if x[2] else x[3], x[4], min(shards - 1, (below if split else start[x[0]]) * shards // total)))
        below += x[4]
    return out


def test_against_one_sorted_pass(spark):
    for rows in (texts(), [(i, "copy " * 50) for i in range(300)] + [(1000 + i, f"own {i}" * 9) for i in range(300)]):
        got = placed(documents(spark, rows)).collect()
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.doc_id, r["size"], r.shard) for r in got), key=key) == sorted(_brute(rows, 40), key=key)
        crc = defaultdict(list)
        for k, t in rows:
            crc[k].append(zlib.crc32((t or "").encode()))
        assert all(r.text_crc32 in crc[r.doc_id] for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bytes_are_near_equal(spark):
    rows = [(i, "hot copy") for i in range(700)] + [(1000 + i, "x" * (i % 50)) for i in range(1400)]
    sums = defaultdict(int)
    for r in placed(documents(spark, rows), shards=5).collect():
        sums[r.shard] += r["size"]
    mean = sum(sums.values()) / 5
    assert set(sums) == set(range(5)) and max(abs(n - mean) for n in sums.values()) < 0.06 * mean


def test_empty_table(spark):
    assert placed(empty(spark)).count() == 0
