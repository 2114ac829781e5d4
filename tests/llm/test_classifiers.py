import random
import zlib

import pytest

from flowverdict.llm import labelled, quality as q, toxicity as x
from tests.llm.conftest import invented

RUDE = ["blockhead", "nincompoop", "scoundrel", "dimwitted"]


def held(i, modulus, out):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == out


def labelled_texts(rows=420):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(rows):
        words = invented(k, rng.randint(30, 200)).split()
        toxic, good = int(k % 3 == 0), int(k % 4 != 1)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        text = " ".join(words)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "),
                               " ".join(w for w in words[:20] for _ in range(15))])
            toxic = int(any(w in text.lower() for w in RUDE))
        docs.append((k, text))
        labels.append((k, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, documents):
    docs, labels = labelled_texts()
    labels += [(None, 1, 1), (10_000, 1, None), (5, None, None)]
    return documents(docs, ["score", "y"]), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"), {i: (g, t) for i, g, t in labels[:422] if i is not None}


@pytest.mark.parametrize("op,place", [(x, 1), (q, 0)])
def test_held_out_accuracy(tables, op, place):
    docs, labels, known = tables
    out = op.scored(docs, op.fit(docs, labels)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(420))
    for r in out:
        assert r["held_out"] == held(r["doc_id"], op.MODULUS, op.HELD_OUT)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    new = [r for r in out if r["held_out"] and known[r["doc_id"]][place] is not None]
    right = sum(r["predicted"] == known[r["doc_id"]][place] for r in new)
    assert len(new) > 50 and right >= 0.93 * len(new)


def test_unseen_spellings_lean_the_same_way(tables):
    docs, labels, _ = tables
    model = x.fit(docs, labels)
    plain = model.word_scores(invented(999, 50).split()).max()
    assert all(model.word_scores([w])[0] > plain for w in ["blokhead", "nincompooop", "scoundrell", "dimwited"])


def test_held_out_labels_are_not_learnt_from(spark, documents):
    docs, labels = labelled_texts(200)
    turned = [(i, 1 - g, 1 - t) if held(i, 5, 0) else (i, g, t) for i, g, t in labels]
    df = documents(docs)
    one, two = (x.fit(df, spark.createDataFrame(r, "doc_id long, quality int, toxic int")) for r in (labels, turned))
    assert (one.push == two.push).all() and one.slope == two.slope


@pytest.mark.parametrize("op", [x, q])
def test_hard_rows_and_few_labels(spark, documents, hard, op):
    docs = documents(hard, ["score"])
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (7, 0, 1), (2, 1, 0), (3, 0, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        out = op.scored(docs, op.fit(docs, table)).collect()
        assert len(out) == len(hard)
        scores = {}
        for r in out:
            assert 0 <= r["score"] <= 1
        keep = op.without_toxic if op is x else op.only_good
        kept = keep(docs, table)
        assert kept.columns == docs.columns
        if not labels:
            assert kept.count() == len(hard)
        del scores
    none = documents([])
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.scored(none, op.fit(none, table)).count() == 0


def test_filters_drop_what_the_score_rejects(tables):
    docs, labels, _ = tables
    bad = {r["doc_id"] for r in x.scored(docs, x.fit(docs, labels)).collect() if r["predicted"]}
    assert {r["doc_id"] for r in x.without_toxic(docs, labels).collect()} == set(range(420)) - bad
    good = {r["doc_id"] for r in q.scored(docs, q.fit(docs, labels)).collect() if r["predicted"]}
    assert {r["doc_id"] for r in q.only_good(docs, labels).collect()} == good


def test_sample_is_bounded_and_whole(tables):
    docs, labels, known = tables
    rows, counts = labelled.sample(docs, labels, "toxic", 5, 0, 30, 8000)
    assert sum(counts.values()) == sum(1 for i, (_, t) in known.items() if t is not None and not held(i, 5, 0))
    for y in (0, 1):
        texts = [t for label, t in rows if label == y]
        assert 0 < len(texts) <= 30 and sum(len(t) for t in texts) <= 8000
    texts = {r["text"] for r in docs.select("text").collect()}
    assert all(t in texts for _, t in rows)
