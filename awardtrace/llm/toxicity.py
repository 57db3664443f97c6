"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and its character n-grams, so a
misspelling shares most of its vector with the word it comes from. A window of words
is the mean of its words; a text is as toxic as its worst window, so a short insult
is not averaged away in a long text.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, text_or_empty

#: The fit draws at most so many labelled rows of each class, of texts up to so many characters. Scores, classes and
#: the share of the classes cover all rows.
ROWS_PER_CLASS = 3000
FIT_CHARS = 20_000
BUCKETS = 1 << 17
NGRAMS = (3, 4, 5)
DIMENSIONS = 8
WINDOW, STRIDE = 8, 4
FOLDS = 5
#: Steps over all texts at once: first by the mean of a text's different words, then by its worst window.
WARM_STEPS, STEPS, RATE, DECAY = 30, 60, 0.05, 1e-4
#: Words a worker remembers before it starts anew.
REMEMBERED = 400_000

_EDGES = ".,;:!?\"'()[]{}#*$%&|<>/\\+=~_-"


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word.strip(_EDGES) or word}>"
    found = [marked[i:i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [marked, *found]]


def _windows(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of a text; the last one may be short."""
    starts = np.arange(0, max(n_words - WINDOW, 0) + STRIDE, STRIDE)
    starts = starts[starts < n_words]
    return starts, np.minimum(starts + WINDOW, n_words)


def _new(ids: np.ndarray) -> np.ndarray:
    """Whether a word does not stand among the WINDOW - 1 words before it; a repeated one adds nothing.

    This goes by distance, so in a window that begins between a word and its repetition
    neither counts, though the repetition is one of the words that the sum is divided by.
    """
    order = np.argsort(ids, kind="stable")
    near = np.zeros(len(ids), dtype=bool)
    near[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (np.diff(order) < WINDOW)
    return ~near


def _means(values: np.ndarray, new: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each window the sum of its words that count over the number of its words."""
    total = np.r_[0.0, np.cumsum(values * new)]
    return (total[ends] - total[starts]) / (ends - starts)


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: the difference of the two logits by bucket, and at the start."""

    by_bucket: list[float]
    bias: float
    scale: float = 1.0

    def word(self, word: str) -> float:
        parts = subwords(word)
        return sum(map(self.by_bucket.__getitem__, parts)) / len(parts)

    def logit(self, words: list[str], known: dict[str, float]) -> float:
        if not words:
            return self.bias
        if len(known) > REMEMBERED:
            known.clear()
        own: dict[str, int] = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in words), dtype=np.int32, count=len(words))
        for w in own:
            if w not in known:
                known[w] = self.word(w)
        values = np.array([known[w] for w in own])[ids]
        return float(_means(values, _new(ids), *_windows(len(words))).max()) * self.scale + self.bias


def fit(texts: list[str], labels: list[int], prior: float, seed: int = 11) -> Model:
    """Train on four of five texts, then scale and shift the logits by the rest.

    ``prior`` is the share of label 1 among all labelled rows, which the drawn rows
    stand for. Without rows of both classes the score is the prior everywhere.
    """
    share = float(np.clip(prior, 1e-4, 1 - 1e-4))
    rows = [(t, y) for t, y in zip(texts, labels) if t.split()]
    apart = {y: [i for i, r in enumerate(rows) if r[1] == y][::5] for y in (0, 1)}
    held = {i for own in apart.values() if len(own) > 4 for i in own}
    model = _train([r for i, r in enumerate(rows) if i not in held], share, seed)
    known: dict[str, float] = {}
    logits = np.array([model.logit(rows[i][0].lower().split(), known) for i in sorted(held)])
    return _scaled(model, logits, np.array([rows[i][1] for i in sorted(held)]), share)


def _scaled(model: Model, logits: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Logistic regression of the label on the logit, by Newton steps, drawn slightly towards what the model says."""
    if not len(y) or y.min() == y.max():
        return model
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    x = np.c_[logits, np.ones(len(y))]
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + 0.1 * (at - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        at = at - np.clip(step, -1, 1)
    scale = float(max(at[0], 0.05))
    return Model(model.by_bucket, model.bias * scale + float(at[1]), scale)


class Bags:
    """Labelled texts as flat arrays: words, windows, and the buckets of every different word."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.y = np.array([y for _, y in rows], dtype=np.float64)
        vocabulary: dict[str, int] = {}
        tokens, new, first, starts, ends, of_text, distinct, distinct_of = [], [], 0, [], [], [], [], []
        for i, (text, _) in enumerate(rows):
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.lower().split()], dtype=np.int32)
            s, e = _windows(len(ids))
            tokens.append(ids)
            new.append(_new(ids))
            starts.append(s + first)
            ends.append(e + first)
            of_text.append(np.full(len(s), i, dtype=np.int32))
            distinct.append(np.unique(ids))
            distinct_of.append(np.full(len(distinct[-1]), i, dtype=np.int32))
            first += len(ids)
        self.tokens, self.new, self.starts, self.ends, self.of_text, self.distinct, self.distinct_of = map(
            np.concatenate, (tokens, new, starts, ends, of_text, distinct, distinct_of))
        self.first_window = np.flatnonzero(np.r_[True, self.of_text[1:] != self.of_text[:-1]])
        self.per_text = np.bincount(self.distinct_of, minlength=len(self.y))
        flat, sizes = array("i"), array("i")  # a list of numbers would take ten times the memory
        for w in vocabulary:
            own = subwords(w)
            flat.extend(own)
            sizes.append(len(own))
        self.grams, self.sizes = np.frombuffer(flat, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32)
        self.gram_at = np.r_[0, np.cumsum(self.sizes)]
        # The classes weigh alike.
        self.weight = np.where(self.y == 1, 0.5 / (self.y == 1).sum(), 0.5 / (self.y == 0).sum()) * len(self.y)

    def loss(self, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray,
             warm: bool) -> tuple[float, tuple[np.ndarray, ...]]:
        """The mean weighted loss with the decay of the embeddings, and its gradients.

        While ``warm`` a text counts by the mean of its different words, then by its worst window.
        """
        texts = len(self.y)
        way = softmax[:, 1] - softmax[:, 0]
        by_word = np.add.reduceat((embeddings @ way)[self.grams], self.gram_at[:-1]) / self.sizes
        if warm:
            used, used_of = self.distinct, self.distinct_of
            part = (8 / self.per_text)[used_of]
            value = np.bincount(used_of, by_word[used] * part, texts)
        else:
            means = _means(by_word[self.tokens], self.new, self.starts, self.ends)
            value = np.maximum.reduceat(means, self.first_window)
            worst = np.flatnonzero(means == value[self.of_text])
            worst = worst[np.r_[True, self.of_text[worst][1:] != self.of_text[worst][:-1]]]  # one window of each text
            length = self.ends[worst] - self.starts[worst]
            place = np.repeat(self.starts[worst] - np.cumsum(length) + length, length) + np.arange(length.sum())
            used, used_of = self.tokens[place], np.repeat(np.arange(texts), length)
            part = (1 / length)[used_of] * self.new[place]
        logit = np.clip(value + bias[1] - bias[0], -40, 40)
        probability = 1 / (1 + np.exp(-logit))
        off = (probability - self.y) * self.weight  # gradient of a text's loss by the difference of the logits
        # Through the words to the buckets: how much each bucket counts in the difference.
        by_vocabulary = np.bincount(used, part * off[used_of], len(self.sizes)) / self.sizes
        by_bucket = np.bincount(self.grams, np.repeat(by_vocabulary, self.sizes), len(embeddings)) / texts
        gradient_way = by_bucket @ embeddings
        gradients = (by_bucket[:, None] * way + DECAY / texts * embeddings, np.c_[-gradient_way, gradient_way],
                     np.array([-off.mean(), off.mean()]))
        surprise = np.logaddexp(0, np.where(self.y == 1, -logit, logit))
        return float((surprise * self.weight).mean() + DECAY / texts / 2 * (embeddings ** 2).sum()), gradients


def _train(rows: list[tuple[str, int]], share: float, seed: int) -> Model:
    if len({y for _, y in rows}) < 2:
        return Model([0.0] * BUCKETS, float(np.log(share / (1 - share))))
    bags = Bags(rows)
    draw = np.random.default_rng(seed)
    embeddings = draw.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax = np.c_[-np.ones(DIMENSIONS), np.ones(DIMENSIONS)] * draw.normal(0, 0.5, (DIMENSIONS, 1))
    bias = np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embeddings, softmax, bias)]
    for step in range(1, WARM_STEPS + STEPS + 1):
        _, gradients = bags.loss(embeddings, softmax, bias, step <= WARM_STEPS)
        for p, g, (m, v) in zip((embeddings, softmax, bias), gradients, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    prior_bias = np.log(share / (1 - share))  # the classes were weighted alike
    return Model((embeddings @ (softmax[:, 1] - softmax[:, 0])).tolist(), float(bias[1] - bias[0] + prior_bias))


def fold(key: Column) -> Column:
    """CRC-32 of the key as text, modulo the number of folds; fold 0 is held out. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on labelled rows outside the held-out fold. A key with both labels counts as 1."""
    known = (labels.where(quoted(label).isNotNull() & quoted(key).isNotNull() & (fold(quoted(key)) != 0))
             .groupBy(quoted(key).alias("_key")).agg(F.max(quoted(label)).cast("int").alias("_label")))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    prior = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    order = (F.xxhash64("_key"), F.col("_key"))
    drawn = None
    for y in (0, 1):
        of_class = known.where(F.col("_label") == y).orderBy(*order).limit(ROWS_PER_CLASS)
        drawn = of_class if drawn is None else drawn.unionByName(of_class)
    short = docs.select(quoted(key).alias("_key"), text_or_empty(text).alias("_text")).where(
        F.char_length("_text") <= FIT_CHARS)
    # At most 2 * ROWS_PER_CLASS keys. A key that repeats gives one of its texts.
    rows = (short.join(F.broadcast(drawn), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
            .orderBy("_key").limit(2 * ROWS_PER_CLASS).toPandas())
    return fit(rows["_text"].tolist(), rows["_label"].tolist(), prior)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` nested under ``row``, with ``score`` (0 to 1) and ``predicted``.

    Null and empty texts get the score of a text without words, the share of label 1; a
    very long one is read whole, in time and memory that grow with it. Rows that repeat get
    the same score. An empty table gives no rows.
    """
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for batch in texts:
            logits = np.array([model.logit(t.lower().split(), known) for t in batch], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -500, 500))))

    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), score(text_or_empty(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with its columns."""
    return scored(docs, train(docs, labels, text, key), text).where("predicted = 0").select("row.*")


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "row.doc_id", (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", "predicted")
