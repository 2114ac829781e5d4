import random
from collections import Counter

import numpy as np
import pytest

from flowverdict.llm import components as c, jaccard as j, words as w
from tests.llm import brute
from tests.llm.conftest import invented


def test_words_and_shingles_are_those_of_the_bytes():
    texts = ["", " ", "A b\x0bC\x0cd", "x" * 3000 + " y", "Ünï a\xa0b ÄB ä", "one\r\ntwo  three", invented(1, 500)]
    w.BLOCK, old = 64, w.BLOCK
    try:
        hashes, at = w.words([t.encode() for t in texts])
    finally:
        w.BLOCK = old
    seen = {}
    for k, text in enumerate(texts):
        plain = brute.words(text)
        assert len(plain) == at[k + 1] - at[k]
        for word, value in zip(plain, hashes[at[k] : at[k + 1]]):
            assert seen.setdefault(word, value) == value
        assert len(set(w.shingles(hashes[at[k] : at[k + 1]]).tolist())) == len(brute.shingle_set(text))
    assert len(set(seen.values())) == len(seen)
    long, _ = w.words([t.encode() for t in texts])
    assert (long == hashes).all()


def linked(sets):
    return [(a, b) for b in range(len(sets)) for a in range(b)
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def classes(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [ra if r == rb else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_connect_what_is_similar(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(1000), rng.randint(1, 40)) for _ in range(4)]
    sets = []
    for _ in range(40):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(0, 1500))
        sets.append(s)
    tokens = [np.array(sorted(s), np.uint64) for s in sets]
    everyone = list(range(len(sets)))
    found = j.trie_links(tokens, everyone, everyone, np.arange(len(sets)))
    assert set(map(lambda p: tuple(sorted(p)), found)) <= set(linked(sets))
    assert classes(len(sets), found) == classes(len(sets), linked(sets))
    left, right = everyone[:15], everyone[15:]
    across = [(a, b) for a, b in linked(sets) if (a < 15) != (b < 15)]
    found = j.trie_links(tokens, left, right, np.arange(len(sets)))
    assert classes(len(sets), found) == classes(len(sets), across)


@pytest.mark.parametrize("task", [100_000, 20])
def test_components(spark, task, monkeypatch):
    monkeypatch.setattr(c, "LINKS_A_TASK", task)
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    out = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = sorted({x for a, b in links for x in (a, b) if a != b})
    want = classes(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in links if a != b])
    assert out == {n: nodes[want[k]] for k, n in enumerate(nodes)}


def near_copies(seed, groups, rows):
    rng = random.Random(seed)
    out = []
    bases = [invented(seed * 100 + k, rng.choice([6, 30, 90, 200])).split() for k in range(groups)]
    line = invented(999, 60).split()
    for k in range(rows):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 50)}"
        if rng.random() < 0.3:
            words = line + words
        out.append((k * 3 + 1, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def compared(df, rows):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())
    want = Counter((i, len(brute.shingle_set(t)), low) for (i, t), low in zip(rows, brute.components(rows)))
    assert got == want


@pytest.mark.parametrize("chunk", [100, 3])
def test_components_of_documents(spark, documents, hard, chunk, monkeypatch):
    monkeypatch.setattr(j, "CHUNK", chunk)
    monkeypatch.setattr(j, "FREQUENT", 3)
    rows = [r for r in hard if r[0] is not None and r[0] != 5] + [(i + 9000, t) for i, t in near_copies(1, 7, 110)]
    rows += [(5000 + k, rows[8][1]) for k in range(30)]
    compared(j.with_components(documents(rows, ["n", "digest", "root"])), rows)


def test_ids_that_are_null_or_repeated(spark, documents, hard):
    compared(j.with_components(documents(hard)), hard)


def test_empty_table(spark, documents):
    assert j.with_components(documents([])).count() == 0
    assert j.deduplicated(documents([])).count() == 0


def test_one_document_of_each_component_stays(spark, documents, hard):
    rows = hard + [(i + 9000, t) for i, t in near_copies(4, 4, 30)] + [(None, "null ids only here"), (None, "Null ids only here")]
    docs = documents(rows, ["digest", "set_digest"])
    out = j.deduplicated(docs)
    assert out.columns == docs.columns
    low = brute.components(rows)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert not got - Counter(rows)
    ids = Counter(i for i, t in got.elements() if i is not None)
    wanted = Counter(i for i, t in rows if not brute.words(t) and i is not None)
    wanted += Counter({m for (i, t), m in zip(rows, low) if brute.words(t) and m is not None})
    assert ids == wanted
    # Of components whose ids are all NULL one row stays each.
    assert sum(1 for i, t in got.elements() if i is None and brute.words(t)) == 2
