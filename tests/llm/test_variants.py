import random
import re
import zlib
from collections import Counter

import numpy as np

from flowverdict.llm import variants as v

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, lost=97):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % lost == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, lost=97):
    n = {w: c for w, c in counts(rows, lost).items() if len(w) >= 5 and c >= 3}
    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    result = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return result


def run(df, **how):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])
            for r in v.variant_groups(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def spelled(seed, words):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeéñÿ÷Àxyz") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    out = []
    for _ in range(words):
        w = rng.choice(stock[: rng.randint(1, 60)])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + "a" + w[k + 1 :]])
        out.append(rng.choice([w, w.upper(), w.capitalize()]))
    return out


def texts(seed):
    words = spelled(seed, 4000)
    cut = [words[k : k + 100] for k in range(0, 4000, 100)]
    return [(k if k % 7 else None, rng_join(c, k)) for k, c in enumerate(cut)]


def rng_join(words, seed):
    rng = random.Random(seed)
    return "".join(w + rng.choice([" ", ", ", "1", "-", "\n", "'", " ¿"]) for w in words)


def test_groups_are_those_of_all_pairs(spark, documents, hard, monkeypatch):
    rows = texts(5) + hard
    want = plain(rows)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # forms of forms
    df = documents(rows, ["word", "n", "form"])
    assert run(df) == want
    # Many shards and passes, few words a time.
    monkeypatch.setattr(v, "FILTER_WORDS", 20)
    monkeypatch.setattr(v, "PASS_BYTES", 300)
    monkeypatch.setattr(v, "CELLS", 50)
    monkeypatch.setattr(v, "HELD", 40)
    assert run(df) == want


def test_long_words_and_lost_letters(spark, documents):
    rng = random.Random(2)
    long = "".join(rng.choice("abcd") for _ in range(3000))
    edge = "".join(rng.choice("abcd") for _ in range(64))
    words = [long] * 6 + [long[:70] + "e" + long[71:]] * 3 + [long[:-1]] * 3 + [edge] * 8 + [edge[1:]] * 4 + [edge[2:]] * 3
    rows = [(k, w) for k, w in enumerate(words)] + [(k, "abcdef abcde fghij") for k in range(100, 900)]
    for lost in (97, 2):
        assert run(documents(rows), lost_every=lost) == plain(rows, lost)


def test_filters_know_their_keys_and_little_else():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    for kind in (7, v.LONG):
        made = v.Filter.load(v.Filter.of(keys, kind).blocks.tobytes(), kind)
        assert made.has(keys).all()
        assert made.has(rng.integers(0, 1 << 63, 50_000).astype(np.uint64)).mean() < 0.01


def test_passes_are_bounded():
    sizes = [(5, 0, 60), (6, 0, 60), (6, 1, 50), (7, 0, 500), (8, 0, 10)]
    assert v.passes(sizes, 110) == [[(5, 0)], [(6, 0), (6, 1)], [(7, 0)], [(8, 0)]]


def test_no_words(spark, documents):
    assert run(documents([])) == set()
    assert run(documents([(1, None), (2, ""), (3, "one two 12 §§")])) == set()
    assert run(documents([(1, "single single single")])) == plain([(1, "single single single")])
