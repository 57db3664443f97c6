from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from awardtrace.llm import toxicity
from awardtrace.llm.toxicity import Bags, Model, fit, not_toxic, scored, subwords, train
from tests.llm.cases import SCHEMA, documents, empty, prose

INSULTS = ["blockhead", "nincompoop", "dunderhead", "scoundrel", "pillock"]


def corpus(n: int):
    """(doc_id, text, label): a third holds an insult somewhere in clean prose."""
    draw = random.Random(4)
    rows = []
    for i in range(n):
        words = prose(i, draw.choice([8, 40, 300])).split()
        if i % 3 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(600)
    docs = documents(spark, [r[:2] for r in rows] + [(9001, None), (9002, ""), (9003, None)])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (9003, None), (3, 1)], "doc_id long, toxic int")
    return rows, docs, labels, train(docs, labels)


def test_held_out_accuracy(spark, trained):
    rows, docs, _, model = trained
    label = {k: y for k, _, y in rows}
    got = scored(docs, model).select("row.doc_id", "score", "predicted").collect()
    assert len(got) == len(rows) + 3
    held = [r for r in got if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(label[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id > 9000}) == 1  # without words the share of label 1


def test_misspellings_share_vectors(trained):
    model = trained[3]
    clean = model.word("lambda7")
    for word in ("blockheadd", "nincompooop", "dunderheads", "scoundrell"):
        assert model.word(word) > clean + 5


def test_fit_is_repeatable_and_stands_one_class():
    rows = corpus(60)
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    a, b = fit(texts, labels, 0.3), fit(texts, labels, 0.3)
    assert a == b
    assert fit(texts, [0] * len(texts), 0.1).logit(["any"], {}) == fit([], [], 0.1).logit([], {})


def test_stage_keeps_columns(spark, trained):
    _, docs, labels, _ = trained
    kept = not_toxic(docs, labels)
    assert kept.schema.fieldNames() == SCHEMA.fieldNames()
    assert 0.6 * docs.count() < kept.count() < 0.75 * docs.count()
    assert not_toxic(empty(spark), labels).count() == 0
    assert not_toxic(docs, labels.limit(0)).count() == docs.count()


def test_fit_gets_3000_rows_of_a_class(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, prior: seen.append((len(texts), sum(labels))))
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('words ', id) AS text")
    train(docs, docs.selectExpr("doc_id", "cast(doc_id < 1000 AS int) AS toxic"))
    toxic = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000))
    assert seen == [(3000 + toxic, toxic)]


def _brute_logit(model, words):
    """Window by window, words that do not stand among the seven before them, over the number of all its words."""
    mean = lambda w: sum(model.by_bucket[b] for b in subwords(w)) / len(subwords(w))
    counts = [w not in words[max(i - 7, 0):i] for i, w in enumerate(words)]
    starts = [s for s in range(0, max(len(words) - 8, 0) + 4, 4) if s < len(words)]
    sums = [sum(mean(w) for w, c in zip(words[s:s + 8], counts[s:s + 8]) if c) / len(words[s:s + 8]) for s in starts]
    return max(sums) * model.scale + model.bias


def test_score_against_brute_force(spark):
    draw = random.Random(7)
    model = Model([draw.gauss(0, 1) for _ in range(toxicity.BUCKETS)], -0.3, 0.7)
    texts = [" ".join(draw.choices(["ab", "cde", "f", "abc", "Xy!"], k=n)) for n in [*range(1, 40), 500, 60_000]]
    texts += ["0 1 2 bad 4 5 bad 7 8 worse 10 11"] * 2
    got = {r.text: r.score for r in scored(documents(spark, list(enumerate(texts))), model).select("row.text", "score").collect()}
    for text in texts:
        want = 1 / (1 + np.exp(-_brute_logit(model, text.lower().split())))
        assert abs(got[text] - want) < 1e-9, text[:60]


@pytest.mark.parametrize("warm", [True, False])
def test_gradient_against_differences(monkeypatch, warm):
    monkeypatch.setattr(toxicity, "BUCKETS", 50)
    draw, rng = random.Random(8), np.random.default_rng(8)
    rows = [(" ".join(draw.choices("ab cd ab efg h ij ij k".split(), k=draw.randrange(1, 30))), i % 3 == 0) for i in range(12)]
    bags = Bags(rows)
    parts = [rng.normal(0, 1, shape) for shape in ((50, 3), (3, 2), (2,))]
    _, gradients = bags.loss(*parts, warm)
    for p, g in zip(parts, gradients):
        for at in list(np.ndindex(p.shape))[:40]:
            losses = []
            for d in (1e-6, -1e-6):
                p[at] += d
                losses.append(bags.loss(*parts, warm)[0])
                p[at] -= d
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5
