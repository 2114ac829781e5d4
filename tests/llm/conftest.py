import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed, words, stock=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(stock)]
    return " ".join(rng.choice(names) for _ in range(words))


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents out of (doc_id, text) pairs."""

    def make(rows, extra=None):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        for name in extra or []:
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


HARD = [
    (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \t\n "),
    (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"),
    (None, "one two"), (None, None), (6, "Ünï cödé <|endoftext|> don't 123 !!"),
    (7, invented(7, 30_000)),
]


@pytest.fixture(scope="session")
def hard():
    """NULLs, empty, repeated and very long texts."""
    return list(HARD)
