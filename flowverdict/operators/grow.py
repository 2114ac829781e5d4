"""Trees of a random forest of two classes, each grown whole in one task.

The rules are those of Spark's trainer (bins, Poisson bags, Gini, merged leaves). It walks all
rows once a level and keeps the trees on the driver; here a task holds all rows in bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BINS = 32
POINTS = 1024  # values of one feature that a batch of rows gives to the choice of borders
BLOCK_ROWS = 16_384  # rows to judge that walk a tree in one go
_SLACK = 1e-8  # a smaller difference of sums of squares over counts is rounding


@dataclass
class Trees:
    """Nodes of all trees of a forest as flat arrays; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    probability: np.ndarray

    def at_depths(self, x: np.ndarray, depths: list[int]) -> np.ndarray:
        """Probability of every row and tree at each of ``depths`` (ascending), where a tree that
        is deeper is cut: (depth, row, tree)."""
        at, row = np.repeat(self.roots, len(x)), np.tile(np.arange(len(x)), len(self.roots))
        live, out = np.arange(len(at)), []
        judged = lambda: self.probability[at].reshape(len(self.roots), len(x)).T
        for level in range(depths[-1] + 1):
            if level in depths:
                out.append(judged())
            live = live[self.feature[at[live]] >= 0]  # the others have reached a leaf
            if not len(live):
                break
            node = at[live]
            low = x[row[live], self.feature[node]] <= self.threshold[node]
            at[live] = np.where(low, self.left[node], self.right[node])
        return np.stack(out + [judged()] * (len(depths) - len(out)))


def features_of_a_split(rule: str, width: int) -> int:
    """Features that a node draws, by the rules of ``RandomForestClassifier``."""
    named = {"auto": math.sqrt(width), "sqrt": math.sqrt(width), "log2": max(1.0, math.log2(width)),
             "onethird": width / 3, "all": width}
    if rule in named:
        return math.ceil(named[rule])
    return min(int(rule), width) if rule.isdigit() else math.ceil(float(rule) * width)


def _matrix(batch: pa.RecordBatch, judged: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and classes of a batch; as in Spark's trainer a gap in them is an error. In rows
    that are only ``judged`` a class may be missing (255) and values may be NaN or infinite."""
    x, y = batch.column("x"), batch.column("y")
    flat = x.flatten()
    if x.null_count or flat.null_count or (y.null_count and not judged):
        raise ValueError("vectors and classes must not be null")
    width, lengths = len(flat) // len(x), np.diff(x.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError("vectors must have one length")
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    if not (judged or np.isfinite(x).all()):
        raise ValueError("vectors must not be NaN or infinite")
    y = y.cast(pa.float64()).fill_null(255).to_numpy(zero_copy_only=False)
    if not np.isin(y, (0, 1, 255) if judged else (0, 1)).all():
        raise ValueError("classes must be 0 and 1")
    return x, y.astype(np.uint8)


def _points(batches):
    """Distinct values of each feature with their counts, batch by batch. Of more than ``POINTS``
    each is the last of a run and counts the run's rows."""
    for batch in batches:
        if not len(batch):
            continue
        values, counts = [], []
        for column in _matrix(batch)[0].T:
            v, n = np.unique(column, return_counts=True)
            if len(v) > POINTS:
                last = np.arange(1, POINTS + 1) * len(v) // POINTS - 1
                v, n = v[last], np.diff(np.cumsum(n)[last], prepend=0)
            values.append(v)
            counts.append(n)
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(range(len(values)), pa.int32()), "value": values, "n": counts})


def _borders(values: np.ndarray, counts: np.ndarray) -> list[float]:
    """Borders of at most ``MAX_BINS`` bins, all middles if there are so few values; else those
    that come nearest to equal shares, as Spark's trainer walks them."""
    values, at = np.unique(values, return_inverse=True)
    below = np.cumsum(np.bincount(at, counts))[:-1].tolist()
    middles = ((values[:-1] + values[1:]) / 2).tolist()
    if len(middles) < MAX_BINS:
        return middles
    stride = counts.sum() / MAX_BINS
    out, target = [], stride
    for k in range(1, len(middles)):
        if abs(below[k - 1] - target) < abs(below[k] - target):
            out.append(middles[k - 1])
            target += stride
    return out[: MAX_BINS - 1]


def _borders_of_feature(key, rows):
    flat = [rows[n].combine_chunks().flatten().to_numpy() for n in ("value", "n")]
    return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "borders": [_borders(*flat)]},
                    pa.schema({"feature": pa.int32(), "borders": pa.list_(pa.float64())}))


@dataclass
class Rows:
    """All rows of a table in bins, one byte a value: (row, feature), and their classes."""

    bins: np.ndarray
    y: np.ndarray  # 255: none


def bin_borders(df: DataFrame) -> list[np.ndarray]:
    """Borders of the bins of every feature of ``df`` (x, y), from all its rows."""
    points = df.mapInArrow(_points, "feature int, value array<double>, n array<bigint>")
    found = points.groupBy("feature").applyInArrow(_borders_of_feature, "feature int, borders array<double>")
    return [np.array(r["borders"]) for r in sorted(found.collect())]


def binned(df: DataFrame, borders: list[np.ndarray], judged: bool = False) -> Rows:
    """``df`` (x, y) in bins on the driver, for tables whose size has been looked at. Rows that
    are only ``judged`` may be without a class."""
    def bins(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch, judged)
            if x.shape[1] != len(borders):
                raise ValueError("vectors must have one length")
            out = np.empty(x.shape, np.uint8)
            for k, b in enumerate(borders):
                out[:, k] = np.searchsorted(b, x[:, k])
            yield pa.RecordBatch.from_pydict({"bins": [out.tobytes()], "y": [y.tobytes()]})

    found = df.mapInArrow(bins, "bins binary, y binary").toArrow()

    def whole(name):
        parts = [np.frombuffer(v.as_buffer(), np.uint8) for v in found[name]]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    return Rows(whole("bins").reshape(-1, len(borders)), whole("y"))


def _best_splits(rows: Rows, at, weight, slot, totals, drawn):
    """Best (sum of squares over counts, feature, bin) of each open node. ``at``, ``weight``,
    ``slot``: number, weight and node of its rows; ``totals``: weights by node and class."""
    width, n = rows.bins.shape[1], totals.sum(axis=1)
    before = np.cumsum(totals, axis=0) - totals
    score, feature, cut = np.full(len(n), -1.0), np.zeros(len(n), int), np.zeros(len(n), int)
    flat, y = rows.bins.ravel(), rows.y[at]
    low = (weight << 1) | y
    for j in range(drawn.shape[1]):
        # Sorted by node and bin, weight and class beside them.
        packed = ((slot * MAX_BINS + flat[at * width + drawn[slot, j]]) << 9) | low
        packed.sort()
        key, w = packed >> 9, (packed >> 1) & 255
        ones, every = np.cumsum(w * (packed & 1)), np.cumsum(w)
        node = key // MAX_BINS
        last = np.flatnonzero((key[1:] != key[:-1]) & (node[1:] == node[:-1]))
        if not len(last):
            continue
        k = node[last]
        l1 = ones[last] - before[k, 1]
        l0 = every[last] - before[k].sum(axis=1) - l1
        r0, r1 = totals[k, 0] - l0, totals[k, 1] - l1
        found = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        most = np.maximum.reduceat(found, starts)
        top = np.flatnonzero(found == np.repeat(most, np.diff(np.r_[starts, len(k)])))
        top = top[np.r_[True, k[top][1:] != k[top][:-1]]]  # the first of a node
        top = top[found[top] > score[k[top]] + _SLACK]
        mine = k[top]
        score[mine], feature[mine], cut[mine] = found[top], drawn[mine, j], key[last[top]] % MAX_BINS
    gain = score - (totals.astype(float) ** 2).sum(axis=1) / n
    return gain > _SLACK, feature, cut


def grown_tree(rows: Rows, depth: int, few: int, rng: np.random.Generator) -> Trees:
    """A tree over a bag of ``rows``, ``few`` features drawn for each node; thresholds are bins."""
    weight = np.minimum(rng.poisson(1.0, len(rows.y)), 255)
    at = np.flatnonzero(weight)
    weight, slot, width = weight[at], np.zeros(len(at), int), rows.bins.shape[1]
    levels, first, nodes = [], 0, 1
    while nodes:
        totals = np.bincount(slot * 2 + rows.y[at], weight, nodes * 2).astype(np.int64).reshape(nodes, 2)
        feature, cut, left = np.full(nodes, -1, np.int32), np.zeros(nodes, np.uint8), np.zeros(nodes, int)
        levels.append((first, feature, cut, left, totals[:, 1] / np.maximum(totals.sum(axis=1), 1)))
        split = np.flatnonzero(totals.all(axis=1)) if len(levels) <= depth else np.zeros(0, int)
        first, nodes = first + nodes, 0
        if not len(split):
            break
        number = np.full(len(feature), -1)
        number[split] = np.arange(len(split))
        slot = number[slot]
        at, weight, slot = at[slot >= 0], weight[slot >= 0], slot[slot >= 0]
        drawn = np.argpartition(rng.random((len(split), width)), few - 1, axis=1)[:, :few]
        good, best, border = _best_splits(rows, at, weight, slot, totals[split], drawn)
        grown = split[good]
        feature[grown], cut[grown] = best[good], border[good]
        left[grown] = first + 2 * np.arange(len(grown))
        child = np.where(good, 2 * (np.cumsum(good) - 1), -1)
        keep = good[slot]
        at, weight, slot = at[keep], weight[keep], slot[keep]
        slot = child[slot] + (rows.bins[at, best[slot]] > border[slot])
        nodes = 2 * len(grown)
    return _merged(levels)


def _merged(levels) -> Trees:
    """The tree of ``levels``; two leaves of equal verdict are one, from the deepest up."""
    feature, cut, left, probability = (np.concatenate([x[k] for x in levels]) for k in (1, 2, 3, 4))
    kept = np.ones(len(feature), bool)
    for first, level, *_ in reversed(levels):
        inner = first + np.flatnonzero(level >= 0)
        a = left[inner]
        leaves = (feature[a] < 0) & (feature[a + 1] < 0)
        same = leaves & ((probability[a] > 0.5) == (probability[a + 1] > 0.5))
        feature[inner[same]] = -1
        kept[a[same]] = kept[a[same] + 1] = False
    left = np.where(feature >= 0, (np.cumsum(kept) - 1)[left], 0)[kept]
    return Trees(np.zeros(1, int), feature[kept], cut[kept], left, left + 1, probability[kept])


def _summed(key, rows):
    """Sums of a block of rows over the tasks, in the order of their trees."""
    rows = rows.sort_by("tree")
    sums = sum(np.array(v.values) for v in rows["sums"])
    y = np.frombuffer(rows["y"][0].as_buffer(), np.uint8)
    ends = np.arange(len(y) + 1, dtype=np.int32) * (len(sums) // len(y))
    return pa.table({"y": pa.array(y.astype(np.int32), mask=y == 255),
                     "sums": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums))})


def cell_sums(sent, spark, sizes: list[tuple[int, int]], features: str, seed: int) -> DataFrame:
    """Rows to judge (y, sums): the sums of the probabilities over the trees of every (number of
    trees, depth). ``sent``: the broadcast ``Rows`` to learn and those to judge.

    A task grows its trees one after the other and judges each at once, so that no tree leaves it.
    Every tree draws by its own number.
    """
    count, depths = max(t for t, _ in sizes), sorted({d for _, d in sizes})

    def grow(batches):
        rows, judged = sent.value
        few = features_of_a_split(features, rows.bins.shape[1])
        sums, first = np.zeros((len(judged.y), len(sizes))), None
        for tree in (t for batch in batches for t in batch.column("id").to_pylist()):
            rng = np.random.default_rng([seed & (2**63 - 1), tree])
            grown, first = grown_tree(rows, depths[-1], few, rng), tree if first is None else first
            for low in range(0, len(sums), BLOCK_ROWS):
                found = grown.at_depths(judged.bins[low : low + BLOCK_ROWS], depths)[:, :, 0]
                for k, (t, d) in enumerate(sizes):
                    if tree < t:
                        sums[low : low + BLOCK_ROWS, k] += found[depths.index(d)]
        for low in range(0, len(sums) if first is not None else 0, BLOCK_ROWS):
            yield pa.RecordBatch.from_pydict({
                "block": [low], "tree": [first], "y": [judged.y[low : low + BLOCK_ROWS].tobytes()],
                "sums": [sums[low : low + BLOCK_ROWS].ravel()]})

    tasks = min(count, 2 * spark.sparkContext.defaultParallelism)
    return spark.range(0, count, 1, tasks).mapInArrow(
        grow, "block bigint, tree bigint, y binary, sums array<double>"
    ).groupBy("block").applyInArrow(_summed, "y int, sums array<double>")
