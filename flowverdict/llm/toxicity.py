"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A word is the mean of the embeddings of its byte n-grams (boundaries marked), a window of
``WINDOW`` words the mean of its words, and a linear softmax over the two classes scores the
window. Unseen spellings share n-grams with seen ones. A document is as toxic as its most toxic
window, so a long text does not thin out what it holds; a last slope and intercept calibrate
that on the sample.

Labels are given for documents, not windows: training takes all windows of toxic documents
first and then, epoch by epoch, those that the model itself finds most toxic.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, is_held_out, table, unused
from .labelled import class_weights, fit_logistic, sample
from .registry import query

MODULUS, HELD_OUT = 5, 0
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20  # of each class
BUCKETS, SIZE, WINDOW = 1 << 16, 8, 10
SHORTEST, LONGEST = 3, 6
EPOCHS, BATCH, RATE, SEED = 6, 512, 0.3, 7
KEPT_WORDS = 250_000
# Toxic windows of the sample that an epoch before the first ranking of windows learns from.
FIRST_WINDOWS = 12_000
EDGES = ".,;:!?\"'()[]{}<>*#$%&|…«»„“”‘’-_"


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word; of one that is too short, the whole."""
    marked = b"<" + word.strip(EDGES).encode() + b">"
    out = [zlib.crc32(marked[k : k + n]) % BUCKETS
           for n in range(SHORTEST, LONGEST + 1) for k in range(len(marked) - n + 1)]
    return out or [zlib.crc32(marked) % BUCKETS]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; a run of one word counts once."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, ["", *words]) if w != before]


class Model:
    """What scoring needs of the trained net: every bucket's push towards class 1."""

    def __init__(self, push: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.push, self.bias, self.slope, self.shift = push.astype(np.float64), bias, slope, shift
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if len(known) + len(missing) > KEPT_WORDS:
            known.clear()
            missing = list(set(words))
        push = self.push
        for word in missing:
            ids = subwords(word)
            known[word] = float(push[ids].sum()) / len(ids)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def margin(self, text: str | None) -> float:
        """Log-odds of the most toxic window; of a text without words, the bias alone."""
        words = words_of(text)
        if not words:
            return self.bias
        scores = self.word_scores(words)
        width = min(WINDOW, len(words))
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        return float((sums[width:] - sums[:-width]).max()) / width + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(text) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Constant:
    """Without labels of both classes: that of the one there is; without any, not toxic."""

    def __init__(self, value: float):
        self.value = value

    def score(self, text: str | None) -> float:
        return self.value


class _Net:
    """Embeddings and softmax under Adagrad; words are rows of a sparse bag of n-grams."""

    def __init__(self, vocabulary: list[str], rng):
        ids, ends = array("i"), array("q", [0])
        for word in vocabulary:
            ids.extend(subwords(word))
            ends.append(len(ids))
        self.ids, self.bounds = np.array(ids), np.array(ends)
        self.sizes = np.diff(self.bounds)
        self.inner = rng.uniform(-1, 1, (BUCKETS, SIZE)) / SIZE
        self.outer = np.zeros((2, SIZE))
        self.bias = np.zeros(2)
        self.seen = [np.full_like(x, 1e-8) for x in (self.inner, self.outer, self.bias)]

    def _bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[words]
        skip = np.repeat(self.bounds[words] - np.cumsum(n) + n, n)
        return self.ids[skip + np.arange(len(skip))], n

    def step(self, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        words, inverse = np.unique(windows, return_inverse=True)
        ids, n = self._bag(words)
        starts = np.cumsum(n) - n
        vectors = np.add.reduceat(self.inner[ids], starts, axis=0) / n[:, None]
        inverse = inverse.reshape(windows.shape)
        hidden = vectors[inverse].mean(axis=1)
        logits = hidden @ self.outer.T + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - np.eye(2)[y]) * weight[:, None] / weight.sum()
        down = (error @ self.outer) / windows.shape[1]
        per_word = np.zeros((len(words), SIZE))
        np.add.at(per_word, inverse.ravel(), np.repeat(down, windows.shape[1], axis=0))
        buckets, place = np.unique(ids, return_inverse=True)
        grad = np.zeros((len(buckets), SIZE))
        np.add.at(grad, place, np.repeat(per_word / n[:, None], n, axis=0))
        self._move(0, self.inner, grad, buckets)
        self._move(1, self.outer, error.T @ hidden, slice(None))
        self._move(2, self.bias, error.sum(axis=0), slice(None))

    def _move(self, k: int, values: np.ndarray, grad: np.ndarray, rows) -> None:
        self.seen[k][rows] += grad * grad
        values[rows] -= RATE * grad / np.sqrt(self.seen[k][rows])

    def model(self) -> Model:
        away = self.outer[1] - self.outer[0]
        return Model(self.inner @ away, float(self.bias[1] - self.bias[0]))

    def word_scores(self) -> np.ndarray:
        push = self.inner @ (self.outer[1] - self.outer[0])
        return np.add.reduceat(push[self.ids], self.bounds[:-1]) / self.sizes


def train(rows: list[tuple[int, str]], counts: dict[int, int]) -> Model | Constant:
    """Fits the net on ``[(label, text)]``; equal rows give equal models.

    ``counts``: labels of each class in the table; they weigh the classes in the calibration.
    """
    rng = np.random.default_rng(SEED)
    number: dict[str, int] = {}
    labels, ids_of = [], []
    for y, text in rows:
        ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
        if len(ids):
            labels.append(y)
            ids_of.append(np.resize(ids, max(len(ids), WINDOW)))
    if len(set(labels)) < 2:
        return Constant(float(max(labels, default=0)))
    net = _Net(list(number), rng)
    del number
    cut_up, owner = [], []
    for d, ids in enumerate(ids_of):
        starts = np.arange(0, max(1, len(ids) - WINDOW + 1), WINDOW // 2)
        cut_up.append(ids[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), d))
    windows, owner = np.concatenate(cut_up), np.concatenate(owner)
    y = np.array(labels)[owner]
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for epoch in range(EPOCHS):
        if epoch < 2:
            picked = rng.choice(toxic, min(len(toxic), FIRST_WINDOWS), replace=False)
        else:
            means = net.word_scores()[windows[toxic]].mean(axis=1)
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, owner[toxic], means)
            bias = float(net.bias[1] - net.bias[0])
            picked = toxic[(means == best[owner[toxic]]) | (means + bias > 0)]
        # As many clean windows as fit, the hardest among them.
        if epoch < 2:
            other = rng.choice(clean, min(len(clean), 3 * len(picked)), replace=False)
        else:
            means = net.word_scores()[windows[clean]].mean(axis=1)
            hard = clean[np.argsort(-means, kind="stable")[: len(picked)]]
            other = np.union1d(hard, rng.choice(clean, min(len(clean), 2 * len(picked)), replace=False))
        batch = rng.permutation(np.concatenate([picked, other]))
        for low in range(0, len(batch), BATCH):
            part = batch[low : low + BATCH]
            net.step(windows[part], y[part], np.ones(len(part)))
    model = net.model()
    margins = np.array([model.margin(t) for _, t in rows])
    labels = [label for label, _ in rows]
    slope, model.shift = fit_logistic(margins, labels, class_weights(labels, counts))
    model.slope = float(slope[0])
    model.known.clear()
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | Constant:
    return train(*sample(docs, labels, "toxic", MODULUS, HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES))


def score_of(text: Column, model: Model | Constant) -> Column:
    """Score from 0 to 1 of a text column; NULL and empty texts are scored as texts without words."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)
        if isinstance(model, Model):
            model.known.clear()
        give_back()

    return scored(text)


def scored(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``."""
    return docs.select(
        "doc_id", is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"),
        score_of(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier finds toxic; all columns are kept."""
    (name,) = unused(docs, "score")
    marked = docs.withColumn(name, score_of(F.col("text"), fit(docs, labels)))
    return marked.where(F.col(name) < 0.5).drop(name)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
