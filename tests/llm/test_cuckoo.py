import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from flowverdict.llm import cuckoo as k

LOWER = str.maketrans(k.UPPER, k.LOWER)


def digest(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).digest()


def check(out, rows, stored=()):
    """``out``: decisions on ``rows``, after ``stored`` rows."""
    groups, before = defaultdict(list), {(i, digest(t)) for i, t in stored}
    for i, t in list(stored) + list(rows):
        groups[digest(t)].append(i)
    kept = defaultdict(list)
    assert sorted(map(str, ((r["doc_id"], r["digest"].hex()) for r in out))) == sorted(
        map(str, ((i, digest(t).hex()) for i, t in rows)))
    for r in out:
        ids = groups[bytes(r["digest"])]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        if r["kept"]:
            assert r["doc_id"] == best
            kept[bytes(r["digest"])].append(r["doc_id"])
    for d in {digest(t) for _, t in rows}:
        best = max((i for i in groups[d] if i is not None), default=None)
        assert len(kept[d]) == ((best, d) not in before)


def texts(seed, n, stock):
    rng = random.Random(seed)
    out = [(rng.randint(0, 10 * n), rng.choice(["Text", "tEXT", "text"]) + f" {rng.randint(0, stock)}") for _ in range(n)]
    return out + [(rng.randint(0, 10 * n), "the one very frequent text") for _ in range(n // 2)]


def test_one_batch(spark, documents, hard, monkeypatch):
    rows = texts(1, 600, 300) + hard + [(8, "ÀB"), (9, "àb"), (10, "Àb"), (11, "x" * 200_000), (12, "X" * 200_000)]
    df = documents(rows, ["keep_id", "digest", "row", "kept", "n"])
    index, out = k.insert(k.empty_index(spark, 100), df)
    check(out.collect(), rows)
    assert index.filters.selectExpr("sum(n) AS n").first()["n"] == len({digest(t) for _, t in rows})
    monkeypatch.setattr(k, "HELD", 3)
    monkeypatch.setattr(k, "CHUNK", 4)
    monkeypatch.setattr(k, "LEAST_SHARDS", 2)  # many digests a shard, many entries a digest
    check(k.insert(k.empty_index(spark, 100), df)[1].collect(), rows)


def test_batches_deletions_and_overflow(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(k, "LEAST_SHARDS", 3)
    monkeypatch.setattr(k, "SHARD_ROWS", 1 << 20)
    first, second, third = texts(1, 40, 60), texts(2, 900, 1500), texts(3, 100, 200)
    index, out = k.insert(k.empty_index(spark, 1), documents(first))
    check(out.collect(), first)
    small = {r["shard"]: len(r["filter"]) for r in index.filters.collect()}
    index, out = k.insert(index, documents(second))  # overflow: resized from the stored digests
    check(out.collect(), second, first)
    assert all(len(r["filter"]) > small[r["shard"]] for r in index.filters.collect())
    index.save(f"{tmp_path}/index")
    index = k.load_index(spark, f"{tmp_path}/index")

    live = first + second
    gone = [r for r in live if r[0] % 3 == 0] + [(-1, "never there"), (None, None)]
    index = k.delete(index, documents(gone))
    live = [r for r in live if (r[0], digest(r[1])) not in {(i, digest(t)) for i, t in gone}]
    assert index.filters.selectExpr("sum(n) AS n").first()["n"] == len({digest(t) for _, t in live})
    asked = [(i, t) for i, t in first + third] + [(5, None)]
    found = k.lookup(index, documents(asked, ["digest"])).collect()
    groups = defaultdict(list)
    for i, t in live:
        groups[digest(t)].append(i)
    assert len(found) == len(asked)
    for r in found:
        ids = groups[digest(r["text"])]
        assert (r["keep_id"], r["group_size"]) == (max(ids, default=None), len(ids))
    index, out = k.insert(index, documents(third))
    check(out.collect(), third, live)


def test_filter_never_loses_a_key():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    live = k.CuckooFilter.of(keys)
    assert live.contains(keys).all() and live.keys == len(keys)
    live.delete(keys[::2])
    live = k.CuckooFilter.load(live.dump())
    assert live.contains(keys[1::2]).all() and live.keys == len(keys[1::2])
    assert live.contains(keys[::2]).mean() < 0.01
    assert live.insert(keys[::2]) and live.contains(keys).all()
    live.delete(keys)
    assert not live.slots.any()


def test_overflow_changes_nothing():
    live = k.CuckooFilter(16)
    keys = np.random.default_rng(3).integers(0, 1 << 63, 100).astype(np.uint64)
    assert live.insert(keys[:30]) and not live.insert(keys[30:])
    assert live.keys == 30 and live.contains(keys[:30]).all()


def test_false_hits_are_verified(spark, documents, monkeypatch):
    """All keys share bucket and fingerprint: the filters say yes to everything."""
    monkeypatch.setattr(k.CuckooFilter, "contains", lambda self, keys: np.ones(len(keys), bool))
    rows, more = texts(4, 50, 30), texts(5, 60, 50)
    index, out = k.insert(k.empty_index(spark, 1), documents(rows))
    check(out.collect(), rows)
    check(k.insert(index, documents(more))[1].collect(), more, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, "")]])
def test_few_rows(spark, documents, rows):
    index, out = k.insert(k.empty_index(spark, 0), documents(rows))
    check(out.collect(), rows)
    assert k.delete(index, documents(rows)).rows.count() == 0
