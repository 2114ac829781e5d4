import math
import random
from collections import Counter

import numpy as np
import pytest

from flowverdict.llm import topk as t


def plain(rows, k=5):
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(kept):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), m) for b, (m, v) in enumerate(kept)
                           if b != a and len(v) == len(q))
            for rank, (score, m) in enumerate(found[:k], 1):
                out[i, rank, m, -score] += 1
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows],
                               "vec_id long, embedding array<float>, copies int, rank int")
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in t.top_k(t.quantised(df)).collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_is_that_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(t, "VECTORS", block)
    monkeypatch.setattr(t, "QUERIES", block)
    monkeypatch.setattr(t, "FIRST_DEPTH", 2)
    rng = random.Random(3)
    rows = [(k * 5, [rng.gauss(0, 1) for _ in range(6)]) for k in range(120)]
    same = [0.5, -0.25, 0.0, 1.0, -1.0, 0.125]
    rows += [(k, same) for k in range(601, 640)] + [(650, same), (650, same), (651, same), (651, same)]
    rows += [(700, None), (701, []), (702, [1.0, None]), (703, [float("nan")] * 6), (750, [float("inf")] * 6),
             (None, same), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (850, [0.0] * 6), (900, [1e7] * 6), (950, same[:5])]
    assert run(spark, rows) == plain(rows)


def test_few_or_no_rows(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(50, [1.0, 2.0])]) == Counter()
    assert run(spark, [(50, [1.0]), (3, [2.0])]) == {(50, 1, 3, 131072): 1}


def test_search_stops_before_the_ends_of_the_lists():
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 100, (4000, 3))
    vectors[17] = 1000
    vectors[5:9] = 900
    lists = t.Lists(np.arange(4000), vectors, np.ones(4000, np.int64))
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[0], slice):
                read.append(key[0].stop)
            return super().__getitem__(key)

    lists.order = lists.order.view(Watched)
    places, _ = lists.best(np.array([1, 2, 3]), 5, -1)
    assert places == [17, 5, 6, 7, 8] and len(read) == 2  # one read of the lists, in both directions
