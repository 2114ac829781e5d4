import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowverdict.llm import covertree as c


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cuttable = sorted(((i, v) for i, _, v in kept if i is not None and v and len(v) % parts == 0))
    width = len(cuttable[0][1]) if cuttable else -1
    step = width // parts if cuttable else 0
    whole = [(i, lab, v) for i, lab, v in kept if i is not None and len(v) == width]
    start = [v for _, v in sorted((i, v) for i, _, v in whole)][:entries]
    books = [[tuple(v[p * step : (p + 1) * step]) for v in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if start else 0):
        of = [defaultdict(list) for _ in range(parts)]
        for _, _, v in whole:
            for p in range(parts):
                x = v[p * step : (p + 1) * step]
                of[p][nearest(p, x)[1]].append(x)
        for p in range(parts):
            for k, xs in of[p].items():
                books[p][k] = tuple(sum(x[d] for x in xs) // len(xs) for d in range(step))
    out, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        if i is None or len(v) != width:
            out.append((i, lab, None, None))
            continue
        found = [nearest(p, v[p * step : (p + 1) * step]) for p in range(parts)]
        error = sum(e for e, _ in found)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), error))
        by_label[lab] += error
    flat = ",".join(str(x) for book in books for e in book for x in e)
    known = {lab for _, lab, code, _ in out if code is not None}
    return Counter((i, code, e, by_label[lab] if lab in known else None) for i, lab, code, e in out), \
        hashlib.sha256(flat.encode()).hexdigest()


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows],
                               "vec_id long, embedding array<float>, label int, code string")
    coded, books = c.coded(c.quantised(df), **how)
    out = c.with_label_error(coded).collect()
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), c.sha256_of(books)


def vectors(seed, n, dims, spread=0.3):
    rng = random.Random(seed)
    return [(k * 3 + rng.randint(0, 2), [rng.gauss(0, spread) for _ in range(dims)], rng.choice([None, 1, 2, 3]))
            for k in range(n)]


def test_codes_are_those_of_all_distances(spark, monkeypatch):
    rows = vectors(1, 500, 32)
    same = [0.25, -0.5] * 16
    rows += [(k, same, 5) for k in range(2000, 2150)] + [(7, same, 1), (7, same, 1), (7, rows[3][1], None)]
    rows += [(3000, None, 1), (3001, [None] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [float("-inf")] * 32, 9),
             (3004, [], 1), (3005, [1.0] * 5, 7), (3006, [0.5] * 16, 2), (None, same, 4), (3007, [-1000.5] * 32, 2)]
    want = plain(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(c, "CHUNK", 37)
    assert run(spark, rows) == want


@pytest.mark.parametrize("n,dims,spread", [(300, 16, 0.02), (40, 64, 0.3), (200, 16, 0.005)])
def test_ties_and_few_rows(spark, n, dims, spread):
    rows = vectors(n, n, dims, spread)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, parts=4, entries=9, rounds=3) == plain(rows, 4, 9, 3)


def test_empty_tables(spark):
    assert run(spark, [])[0] == Counter()
    rows = [(1, [1.0] * 5, 2), (2, None, 2)]
    assert run(spark, rows) == plain(rows)


def test_tree_covers_and_separates():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-120, 120, (3000, 4)), rng.integers(-5, 5, (500, 4))])
    tree = c.build(points)
    assert (tree.points[tree.row_of] == points).all() and tree.weight.sum() == len(points)
    for k in range(len(tree.start)):
        members = tree.points[tree.start[k] : tree.end[k]]
        far = np.sqrt(((members - members[0]) ** 2).sum(axis=1))
        assert math.isclose(far.max(), tree.radius[k])
        down = range(tree.child[k], tree.child[k] + tree.children[k])
        if len(down):
            assert sum(tree.end[j] - tree.start[j] for j in down) == len(members)
            assert max(tree.radius[j] for j in down) <= tree.radius[k] / 2
            centres = tree.points[tree.start[list(down)]]
            apart = np.sqrt(c.squares(centres, centres)) + np.eye(len(centres)) * 1e9
            assert apart.min() > tree.radius[k] / 2
        else:
            assert len(members) <= c.LEAF or len(members) == 1


def test_whole_subtrees_are_assigned():
    """Far fewer points are compared one by one than there are."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-20, 20, (4000, 4)) + m for m in rng.integers(-900, 900, (16, 4))])
    tree, entries = c.build(points), rng.integers(-900, 900, (16, 4))
    alone = sum(int((hi - lo == 1).sum()) for lo, hi, _ in c.walk(tree, entries))
    assert alone < 0.2 * len(tree.points)
    near, error = c.nearest(tree, entries)
    want = c.squares(points, entries)
    assert (near == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()
    n, s = c.totals(tree, entries)
    assert (n == np.bincount(near, minlength=16)).all()
    assert all((s[k] == points[near == k].sum(axis=0)).all() for k in range(16))
