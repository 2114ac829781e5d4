from collections import Counter

import pytest

import corpus_pipeline as c
from flowverdict.llm import packing, quality, toxicity
from tests.llm import brute
from tests.llm.conftest import invented
from tests.llm.test_classifiers import labelled_texts
from tests.llm.test_decontaminate import plain
from tests.llm.test_packing import check_slots, whole


@pytest.fixture(scope="module")
def folder_of_tables(spark, documents, hard, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = labelled_texts(240)
    items = [(k, invented(800 + k, 40)) for k in range(3)]
    docs += [(1000 + k, f"{invented(900 + k, 30)} {items[k % 3][1]} {invented(950 + k, 20)}") for k in range(6)]
    docs += [(2000 + k, docs[2][1] + (" end" if k % 2 else "")) for k in range(5)]
    docs += [(i if i is None else i + 9000, t) for i, t in hard]
    documents(docs, ["score"]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages_against_plain_ones(spark, folder_of_tables):
    folder, rows, items = folder_of_tables
    read = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rude = toxicity.fit(read, labels)
    left = [r for r in rows if rude.score(r[1]) < 0.5]
    docs = c.cut(c.STAGES[0][1](spark, read, folder), "a")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(left)
    good = quality.fit(docs, labels)
    left = [r for r in left if good.score(r[1]) >= 0.5]
    docs = c.cut(c.STAGES[1][1](spark, docs, folder), "b")
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(left)
    low = brute.components(left)
    docs = c.cut(c.STAGES[2][1](spark, docs, folder), "c")
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not Counter(got) - Counter(left)
    assert Counter(i for i, t in got if brute.words(t) and i is not None) == Counter(
        {m for (i, t), m in zip(left, low) if brute.words(t) and m is not None})
    bad = {r for r, _ in plain(got, items)}
    left = [r for k, r in enumerate(got) if k not in bad]
    assert bad
    docs = c.cut(c.STAGES[3][1](spark, docs, folder), "d")
    assert docs.columns == read.columns
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(left)
    out = c.STAGES[4][1](spark, docs, folder).collect()
    check_slots(out, packing.CAPACITY)
    assert Counter((r["doc_id"], r["piece"]) for r in out) == Counter(
        (i, n) for i, t in left for n in range(-(-(len(whole(t or "")) + 1) // packing.CAPACITY)))


def test_run_is_the_stages_one_after_another(spark, folder_of_tables):
    folder, _, _ = folder_of_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in c.STAGES:
        docs = c.cut(stage(spark, docs, folder), "x")
    key = lambda df: Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(c.run(spark, folder)) == key(docs)


def test_empty_table(spark, documents, folder_of_tables, tmp_path):
    folder, _, _ = folder_of_tables
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
