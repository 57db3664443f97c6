from __future__ import annotations

from collections import defaultdict

from awardtrace.llm.mixing import mix, mixed
from tests.llm.cases import SCHEMA, documents, empty, texts


def _targets(sizes):
    """The excess over twice a source's size goes round among the others until none is above."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] >= 2 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    got = mix(docs).collect()
    assert len(got) == len(texts())
    source = defaultdict(int)
    for r in docs.select("source", "text").collect():
        source[r.source] += len((r.text or "").split())
    want = _targets(dict(source))
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted((n, round(want[s], 6)) for s, n in source.items())
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.repeats * r["size"]
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r["size"])
    for k, n in taken.items():
        assert abs(n - k[1]) <= largest[k]


def test_reruns_and_rows_agree(spark):
    docs = documents(spark)
    again = [sorted(map(str, mix(d).collect())) for d in (docs, docs.repartition(7))]
    assert again[0] == again[1]
    rows = mixed(docs)
    assert rows.schema.fieldNames() == SCHEMA.fieldNames()
    assert rows.count() == sum(r.repeats for r in mix(docs).collect())


def test_empty_table_and_no_words(spark):
    assert mix(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0
    got = mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
