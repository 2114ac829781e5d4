"""Quality by compression: which labelled class compresses a text better.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is cut into
pieces, so that the dictionaries matter all along a long text, and every piece is compressed
with either. The evidence is the difference of the total sizes over their sum, and beside it the
compressed share of the text (words repeated over and over compress well with any dictionary).
A logistic curve fitted on labelled texts that built no dictionary turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, is_held_out, table, unused
from .labelled import class_weights, fit_logistic, sample
from .registry import query

MODULUS, HELD_OUT = 3, 1
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20  # of each class
PIECE, DICTIONARY, LEVEL = 512, 1 << 16, 3


def cut_up(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[k : k + PIECE] for k in range(0, len(data), PIECE)]


class Model:
    """Both dictionaries and the calibration; the compressors are made where it is used."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.slopes, self.shift = good, bad, np.zeros(2), 0.0
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Normalised difference, above 0 where the good dictionary compresses better, and the
        compressed share; an empty text has no difference and the share of incompressible text."""
        import zstandard as z

        if self.tools is None:
            self.tools = []
            for d in (self.good, self.bad):
                built = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO)
                built.precompute_compress(level=LEVEL)
                self.tools.append(z.ZstdCompressor(
                    level=LEVEL, dict_data=built, write_checksum=False, write_content_size=False,
                    write_dict_id=False).compress)
        pieces = cut_up(text)
        good, bad = (sum(map(len, map(tool, pieces))) for tool in self.tools)
        return ((bad - good) / (bad + good), min(good / sum(map(len, pieces)), 1.0)) if pieces else (0.0, 1.0)

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.slopes, self.evidence(text))) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Constant:
    """Without labels of both classes: that of the one there is; without any, good."""

    def __init__(self, value: float):
        self.value = value

    def score(self, text: str | None) -> float:
        return self.value


def dictionary(texts: list[str]) -> bytes:
    import zstandard as z

    pieces = [p for t in texts for p in cut_up(t) if p]
    try:
        return z.train_dictionary(DICTIONARY, pieces).as_bytes()
    except z.ZstdError:  # too few samples to select from: their text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def train(rows: list[tuple[int, str]], counts: dict[int, int]) -> Model | Constant:
    """Dictionaries from every second text of a class, calibration on the others.

    ``counts``: labels of each class in the table; they weigh the classes in the calibration.
    """
    texts = {y: [t for label, t in rows if label == y and t] for y in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return Constant(float(max((y for y in texts if texts[y]), default=1)))
    model = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]))
    rest = [(label, t) for label in (0, 1) for t in texts[label][1::2]]
    y = [label for label, _ in rest]
    model.slopes, model.shift = fit_logistic(
        [model.evidence(t) for _, t in rest], y, class_weights(y, counts))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | Constant:
    rows, counts = sample(docs, labels, "quality", MODULUS, HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES)
    return train(rows, counts)


def score_of(text: Column, model: Model | Constant) -> Column:
    """Score from 0 to 1 of a text column; NULL and empty texts get the score of no evidence."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)
        give_back()

    return scored(text)


def scored(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row for each row of ``docs``."""
    return docs.select(
        "doc_id", is_held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"),
        score_of(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier finds bad; all columns are kept."""
    (name,) = unused(docs, "score")
    marked = docs.withColumn(name, score_of(F.col("text"), fit(docs, labels)))
    return marked.where(F.col(name) >= 0.5).drop(name)


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
