import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from flowverdict.llm import ppm as p
from tests.llm import brute
from tests.llm.conftest import invented


def plain_trie(texts):
    seen = defaultdict(Counter)
    for t in texts:
        s = bytes([10]) * p.ORDER + b" ".join(brute.words(t)) + b"\n"
        for k in range(p.ORDER, len(s)):
            for order in range(p.ORDER + 1):
                seen[s[k - order : k]][s[k]] += 1
    return seen


def plain_probability(seen, context, byte):
    p_, excluded = 1.0, set()
    for order in range(p.ORDER, -1, -1):
        after = {b: n for b, n in seen.get(context[p.ORDER - order :], {}).items() if b not in excluded}
        if not after:
            continue
        room = sum(after.values()) + len(after)
        if byte in after:
            return p_ * after[byte] / room
        p_ *= len(after) / room
        excluded |= set(after)
    return p_ / (256 - len(excluded))


def plain_score(seen, text):
    s = bytes([10]) * p.ORDER + b" ".join(brute.words(text)) + b"\n"
    return sum(math.log10(plain_probability(seen, s[k - p.ORDER : k], s[k])) for k in range(p.ORDER, len(s)))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_probabilities_sum_to_one():
    seen = plain_trie([invented(1, 30), invented(2, 30)])
    trie = built([invented(1, 30), invented(2, 30)])
    rng = random.Random(1)
    for context in [b"\n" * 5, b"\n\n\nab", b"zzzzz", *[bytes(rng.choice(b"abcdefghij ") for _ in range(5)) for _ in range(20)]]:
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        found = trie.log10(keys)
        assert abs((10 ** found).sum() - 1) < 1e-9
        for b in (10, 32, 97, 200):
            assert abs(found[b] - math.log10(plain_probability(seen, context, b))) < 1e-9


def built(texts):
    found = Counter()
    for t in texts:
        found.update(p.grams(p.normal([t.encode()])).tolist())
    keys = np.array(sorted(found), np.uint64)
    return p.Trie(keys, np.array([found[k] for k in keys.tolist()]))


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_scores(spark, documents, hard, head, monkeypatch):
    monkeypatch.setattr(p, "HEAD_WORDS", head)
    rows = [(i, t if t is None or len(t) < 9000 else invented(7, 900)) for i, t in hard]
    rows += [(50 + k, invented(k % 7, 40, 60)) for k in range(40)]
    trained = [t for i, t in rows if not held(i)]
    seen = plain_trie(trained)
    counts = Counter(w for t in trained for w in [*brute.words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    out = p.scored(documents(rows, ["score", "n_tokens", "copies"])).collect()
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6), round(r["score"], 6)) for r in out)
    want = Counter()
    for i, t in rows:
        tokens = [*brute.words(t), None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens)
        want[i, held(i), len(tokens), sum(counts[x] > 0 for x in tokens), total,
             round(base, 6), round(plain_score(seen, t), 6)] += 1
    assert got == want


def test_nothing_to_learn_from(spark, documents):
    only = next(i for i in range(99) if held(i))
    (row,) = p.scored(documents([(only, "ab c")])).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0
    assert abs(row["score"] + 5 * math.log10(256)) < 1e-9
    assert p.scored(documents([])).count() == 0


def test_a_trie_over_its_size_keeps_the_frequent_part(spark, documents, monkeypatch):
    rows = [(k, "the cat sat on the mat " * 5 + invented(k, 5)) for k in range(30)]
    whole = {r["doc_id"]: r["score"] for r in p.scored(documents(rows)).collect()}
    monkeypatch.setattr(p, "MOST_GRAMS", 60)
    part = {r["doc_id"]: r["score"] for r in p.scored(documents(rows)).collect()}
    assert all(math.isfinite(x) and x <= 0 for x in part.values()) and sum(part.values()) < sum(whole.values())


@pytest.mark.parametrize("most", [0, 60, 900])
def test_scores_do_not_depend_on_the_grams_sent(spark, documents, hard, most, monkeypatch):
    rows = [(i, t if t is None or len(t) < 9000 else invented(7, 900)) for i, t in hard]
    rows += [(50 + k, invented(k % 7, 40, 60)) for k in range(20)]
    rows += [(90 + k, "rare \u0416\u4e2d zq" + "xj" * k) for k in range(10)]
    whole = Counter((r["doc_id"], round(r["score"], 6)) for r in p.scored(documents(rows)).collect())
    seen = plain_trie([t for i, t in rows if not held(i)])
    assert sum(len(v) for k, v in seen.items() if len(k) == p.ORDER) > most
    monkeypatch.setattr(p, "MOST_GRAMS", most)
    monkeypatch.setattr(p, "HOT_GRAMS", 5)
    part = Counter((r["doc_id"], round(r["score"], 6)) for r in p.scored(documents(rows)).collect())
    assert part == whole == Counter((i, round(plain_score(seen, t), 6)) for i, t in rows)


def test_counting_gives_an_earlier_trie_back(monkeypatch):
    monkeypatch.setattr(p, "_tries", {"earlier": (built(["abc abc"]),)})
    found = list(p._count(iter([pa.record_batch([pa.array(["ab c", None])], ["text"])])))
    assert not p._tries and sum(b.num_rows for b in found) > 0


def test_keys_are_held_once():
    """The look-up has no copy of the keys, and the trie none of those it is given."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000, np.uint64))
    table = p.Table(keys)
    assert sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) == keys.nbytes + table.slots.nbytes
    asked = np.concatenate([keys, keys + np.uint64(1), np.zeros(1, np.uint64)])
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert table.find(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    trie = p.Trie(keys, np.ones(len(keys)))
    assert trie.grams[p.ORDER] is keys and trie.top.keys is keys
    mixed = np.random.default_rng(2).permutation(keys)
    assert np.array_equal(p.Trie(mixed, np.ones(len(keys))).log10(asked), trie.log10(asked))
