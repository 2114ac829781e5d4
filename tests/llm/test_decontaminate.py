import random
from collections import Counter

import pytest

from flowverdict.llm import decontaminate as d
from tests.llm import brute
from tests.llm.conftest import invented

ITEMS = [(k, invented(500 + k, n)) for k, n in enumerate([1, 3, 4, 5, 9, 20, 33, 47, 60, 150, 400])]
ITEMS += [(50, None), (51, ""), (None, invented(77, 25)), (5, ITEMS[5][1])]


def shingles(words):
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain(rows, items):
    """{(row, item): best similarity} over all windows as large as the item."""
    out = {}
    for r, (_, text) in enumerate(rows):
        words = brute.words(text)
        for item, passage in {(i, t) for i, t in items if brute.words(t)}:
            wanted = brute.words(passage)
            n, want = len(wanted), shingles(brute.words(passage))
            best = 0.0
            for k in range(max(1, len(words) - n + 1)):
                got = shingles(words[k : k + n])
                both = sum((want & got).values())
                best = max(best, both / max(1, sum(want.values()) + sum(got.values()) - both))
            if best >= 0.8:
                out[r, item] = round(best, 9)
    return out


def leaky(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        words = invented(seed * 1000 + k, rng.randint(0, 120)).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage = brute.words(rng.choice(ITEMS)[1])
            passage = [w.decode() for w in passage]
            n = len(passage)
            for _ in range(rng.randint(0, n // 45)):
                passage[rng.randrange(n)] = "changed"
            if rng.random() < 0.3 and n > 30:
                passage = passage[1:]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in passage]
        rows.append((k, rng.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_are_those_of_all_windows(spark, documents, hard, seed):
    rows = hard + [(i + 9000, t) for i, t in leaky(seed)]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = d.leaks(documents(rows, ["item_id", "similarity"]), benchmark).collect()
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in out)
    assert got == Counter((rows[r][0], item, like) for (r, item), like in plain(rows, ITEMS).items())


def test_a_large_benchmark_takes_several_passes(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "PASS_WORDS", 60)
    rows = leaky(3)
    docs = documents(rows, ["leaked"])
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {rows[r][0] for r, _ in plain(rows, ITEMS)}
    assert {r["doc_id"] for r in d.leaks(docs, benchmark).collect()} == bad
    out = d.decontaminated(docs, benchmark)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in rows if i not in bad)


def test_empty_tables(spark, documents):
    items, none = (spark.createDataFrame(x, "item_id long, text string") for x in (ITEMS, []))
    assert d.leaks(documents([]), items).count() == 0
    assert d.leaks(documents([(1, "a b c")]), none).count() == 0
    assert d.decontaminated(documents([(1, "a b c")]), none).count() == 1


def test_all_fingerprints_within_the_radius_are_candidates():
    rng = random.Random(9)
    text = invented(9, 3000).encode()
    index = d.Index([(k, invented(60 + k, 21).encode()) for k in range(300)])
    from flowverdict.llm import words as w

    hashes, at = w.words([text])
    size = d.ladder(21)
    prints, places, *_ = index.sizes[size]
    sums = d.bit_sums(hashes, size)
    found = d.fingerprints(sums, size)
    for p in rng.sample(range(len(found)), 40):
        flipped = int(found[p])
        for bit in rng.sample(range(64), d.RADIUS):
            flipped ^= 1 << bit
        one = d.Index([(0, invented(60, 21).encode())])
        one.sizes = {size: _only(flipped)}
        assert p in {start for _, _, start in one.candidates(hashes, at)}


def _only(value):
    import numpy as np

    prints = np.array([value], np.uint64)
    blocks = prints.view("<u2").reshape(-1, d.BLOCKS).astype(np.int64)
    first = [np.searchsorted(blocks[:, b], np.arange((1 << 16) + 1)) for b in range(d.BLOCKS)]
    return prints, np.array([[0, 0]]), [np.diff(f) > 0 for f in first], np.zeros((1, d.BLOCKS), int), first
