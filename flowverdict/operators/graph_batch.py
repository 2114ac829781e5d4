"""Numpy arithmetic of the graph network on one Arrow batch of call graphs.

All graphs of a batch form one block-diagonal graph, so a layer is a few array
operations however many graphs there are. Spark decides which graphs meet in a batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

REACH_ROWS = 32_000  # pairs of edges that are explained in one go
PRODUCT_ROWS = 256  # rows of a matrix product whose rows must not depend on their number
DENSE_NODES = 64  # nodes up to which the messages of a graph are one small matrix product


@dataclass
class Weights:
    """Layers ``(W, b)`` and the linear head ``(w, b)``."""

    layers: list
    head: tuple

    @property
    def depth(self) -> int:
        return len(self.layers)

    def flat(self) -> np.ndarray:
        parts = [p.ravel() for layer in self.layers for p in layer]
        return np.concatenate([*parts, self.head[0], [self.head[1]]])

    def like(self, flat: np.ndarray) -> "Weights":
        at, layers = 0, []
        for w, b in self.layers:
            new_w = flat[at : at + w.size].reshape(w.shape)
            new_b = flat[at + w.size : at + w.size + b.size]
            layers.append((new_w, new_b))
            at += w.size + b.size
        n = self.head[0].size
        return Weights(layers, (flat[at : at + n], float(flat[at + n])))


def initial_weights(hidden: int = 64, depth: int = 2, seed: int = 42) -> Weights:
    """Glorot-uniform matrices, zero biases."""
    rng = np.random.default_rng(seed)

    def glorot(rows, cols):
        limit = np.sqrt(6.0 / (rows + cols))
        return rng.uniform(-limit, limit, (rows, cols))

    layers = [
        (glorot(1 if i == 0 else hidden, hidden), np.zeros(hidden)) for i in range(depth)
    ]
    return Weights(layers, (glorot(hidden, 1)[:, 0], 0.0))


@dataclass
class Batch:
    """Nodes of all graphs and their distinct edges without self-loops."""

    size: int  # graphs, empty ones included
    graph: np.ndarray  # of each node
    nodes: np.ndarray  # per graph
    x: np.ndarray
    source: np.ndarray
    target: np.ndarray
    copies: np.ndarray
    norm: np.ndarray  # of one copy of each edge
    loop: np.ndarray  # weight of the self-loop of each node
    edge_graph: np.ndarray  # of every distinct edge, self-loops included
    edge_row: np.ndarray  # its place in source/target above, -1 for a self-loop
    listed: np.ndarray  # distinct edge of every edge as listed

    # Made once, whatever the number of layers and nets; nodes lie by graph, edges by source.
    @cached_property
    def first(self) -> np.ndarray:
        """The first node of each graph."""
        return np.cumsum(self.nodes) - self.nodes

    @cached_property
    def edges(self) -> np.ndarray:
        """Edges of each graph in ``source`` and ``target``."""
        return np.bincount(self.graph[self.source], minlength=self.size)

    @cached_property
    def received(self) -> np.ndarray:
        """What the nodes get of the input: the same for the first layer of every net."""
        sent = self.copies * self.norm * self.x[self.source]
        sums = np.bincount(self.target, sent, len(self.graph))
        return (sums + self.loop * self.x)[:, None]

    @cached_property
    def blocks(self) -> list:
        """Node range and message matrix (to, from) of every graph of at most ``DENSE_NODES``."""
        n = np.where(self.nodes <= DENSE_NODES, self.nodes, 0)
        ends = np.cumsum(n * n)
        flat = np.zeros(ends[-1] if len(ends) else 0)
        at = ends - n * n - self.first * (n + 1)  # of node (0, 0), were nodes counted from here

        def put(to, source, value):
            g = self.graph[to]
            small = n[g] > 0
            to, source, g = to[small], source[small], g[small]
            flat[at[g] + to * n[g] + source] = value[small]

        every = np.arange(len(self.graph))
        put(every, every, self.loop)
        put(self.target, self.source, self.copies * self.norm)
        return [(lo, lo + k, flat[end - k * k : end].reshape(k, k))
                for lo, k, end in zip(self.first.tolist(), n.tolist(), ends.tolist()) if k]

    @cached_property
    def wide(self) -> tuple:
        """Nodes of the larger graphs, and their edges: source, target among these nodes, weight."""
        nodes = (self.nodes > DENSE_NODES)[self.graph]
        mine = nodes[self.source]
        place = np.cumsum(nodes) - 1
        weight = (self.copies * self.norm)[mine][:, None]
        return np.flatnonzero(nodes), place[self.source[mine]], place[self.target[mine]], weight

    @cached_property
    def by_target(self) -> "_Sums":
        return _Sums(self.wide[2], len(self.wide[0]))

    @cached_property
    def by_source(self) -> "_Sums":
        return _Sums(self.wide[1], len(self.wide[0]), ordered=True)

    @cached_property
    def by_graph(self) -> "_Sums":
        return _Sums(self.graph, self.size, ordered=True)

    def messages(self, h: np.ndarray, back: bool = False) -> np.ndarray:
        """What every node receives of the rows ``h``, its own included; ``back`` along the edges
        turned round."""
        out = np.empty_like(h)
        for lo, hi, block in self.blocks:
            np.dot(block.T if back else block, h[lo:hi], out=out[lo:hi])
        rows, source, target, weight = self.wide
        mine = h[rows]
        sent = mine[target if back else source]
        sent *= weight
        mine *= self.loop[rows][:, None]
        mine += (self.by_source if back else self.by_target)(sent)
        out[rows] = mine
        return out

    def picked(self, graphs: np.ndarray) -> "Batch":
        """Some of the graphs in the order given, for fitting: without what explains edges."""
        n, m = self.nodes[graphs], self.edges[graphs]
        at = _ranges(self.first[graphs], n)
        e = _ranges((np.cumsum(self.edges) - self.edges)[graphs], m)
        moved = np.repeat(np.cumsum(n) - n - self.first[graphs], m)
        return Batch(
            len(graphs), np.repeat(np.arange(len(graphs)), n), n, self.x[at],
            self.source[e] + moved, self.target[e] + moved, self.copies[e], self.norm[e],
            self.loop[at], None, None, None,
        )


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[i]`` numbers from ``first[i]`` on, one range after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def make_batch(graphs: pa.Array, counts: bool = False) -> Batch:
    """``graphs``: list<struct<fromId, toId[, n]>>, one list per graph."""
    if isinstance(graphs, pa.ChunkedArray):
        graphs = graphs.combine_chunks()
    size = len(graphs)
    lengths = np.asarray(graphs.value_lengths().fill_null(0))
    flat = graphs.flatten()
    ends = [flat.field("fromId"), flat.field("toId")]
    both = pa.concat_arrays([e.cast(pa.string()) for e in ends]).dictionary_encode(
        null_encoding="encode")
    codes = np.asarray(both.indices).astype(np.int64)
    total = len(flat)
    copies = (
        np.asarray(flat.field("n")).astype(float) if counts else np.ones(total)
    )
    of = np.repeat(np.arange(size), lengths)
    span = max(len(both.dictionary), 1)
    keys, place = np.unique(np.concatenate([of, of]) * span + codes, return_inverse=True)
    graph = keys // span
    v = len(keys)
    source, target = place[:total], place[total:]
    x = np.bincount(source, copies, v) + np.bincount(target, copies, v)
    pair, where = np.unique(source * max(v, 1) + target, return_inverse=True)
    number = np.bincount(where, copies, len(pair))
    a, b = pair // max(v, 1), pair % max(v, 1)
    plain = a != b
    row = np.where(plain, np.cumsum(plain) - 1, -1)
    s, t, n = a[plain], b[plain], number[plain]
    degree = 1.0 + np.bincount(t, n, v)
    return Batch(
        size, graph, np.bincount(graph, minlength=size), x, s, t, n,
        1.0 / np.sqrt(degree[s] * degree[t]), 1.0 / degree,
        graph[a], row, where,
    )


class _Sums:
    """Row sums by a fixed target index, over sorted runs. ``ordered``: the index ascends."""

    def __init__(self, index, size, ordered=False):
        self.size = size
        self.order = None if ordered else np.argsort(index, kind="stable")
        index = index if ordered else index[self.order]
        self.starts = np.flatnonzero(np.diff(index, prepend=-1))
        self.keys = index[self.starts]

    def __call__(self, rows):
        rows = rows if self.order is None else rows[self.order]
        if 0 < len(self.keys) == self.size:
            return np.add.reduceat(rows, self.starts, axis=0)
        out = np.zeros((self.size, rows.shape[1]))
        if len(self.keys):
            out[self.keys] = np.add.reduceat(rows, self.starts, axis=0)
        return out


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))


def _even_product(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``a @ w`` in products of one shape: BLAS rounds a row otherwise where it meets more rows."""
    whole = np.zeros((-(-len(a) // PRODUCT_ROWS) * PRODUCT_ROWS, a.shape[1]))
    whole[: len(a)] = a
    out = np.matmul(whole.reshape(-1, PRODUCT_ROWS, a.shape[1]), w)
    return out.reshape(-1, w.shape[1])[: len(a)]


def forward(batch: Batch, weights: Weights, even: bool = False):
    """Probability per graph (0.0 for graphs without nodes), its logit, the last layer's rows and
    the layer values. ``even``: the products give a node the same bits in batches of any size."""
    product = _even_product if even else np.matmul
    h, kept = None, []
    for w, b in weights.layers:
        a = batch.received if h is None else batch.messages(h)
        z = product(a, w)
        z += b
        kept.append((a, z))
        h = np.maximum(z, 0.0)
    sums = batch.by_graph(product(h, weights.head[0][:, None]))[:, 0]
    logit = sums / np.maximum(batch.nodes, 1) + weights.head[1]
    return np.where(batch.nodes > 0, _sigmoid(logit), 0.0), logit, h, kept


def gradients(batch: Batch, weights: Weights, y: np.ndarray, pos_weight: float = 1.0):
    """Gradient sum of the weighted cross entropy, loss sum and number of graphs."""
    p, _, h, kept = forward(batch, weights)
    there = batch.nodes > 0
    weight = np.where(y == 1, pos_weight, 1.0) * there
    clipped = np.clip(p, 1e-12, 1 - 1e-12)
    loss = -(weight * np.where(y == 1, np.log(clipped), np.log(1 - clipped))).sum()
    dz = weight * (p - y)
    share = (dz / np.maximum(batch.nodes, 1))[batch.graph]
    head = share @ h, dz.sum()
    dh = share[:, None] * weights.head[0]
    layers = []
    for k in reversed(range(weights.depth)):
        (w, _), (a, z) = weights.layers[k], kept[k]
        dh *= z > 0
        layers.append((a.T @ dh, dh.sum(0)))
        if k == 0:
            break  # nothing learns from the input's gradient
        dh = batch.messages(dh @ w.T, back=True)
    grads = Weights(layers[::-1], (head[0], float(head[1])))
    return grads.flat(), float(loss), int(there.sum())


def edge_importance(batch: Batch, weights: Weights):
    """max(0, p - p without one copy of the edge's message) of every distinct edge.

    Degrees, features and nodes stay, as with an edge mask. Taking out u -> v changes
    layer 1 at v only, and layer 2 at v and where v points to, so each edge costs its
    neighbourhood and not the graph. Self-loops carry no message of their own: 0.
    """
    if weights.depth > 2:
        raise ValueError("edges are explained for one or two layers")
    p, logit, _, kept = forward(batch, weights)
    (w1, b1) = weights.layers[0]
    a1, z1 = kept[0]
    s, t, norm = batch.source, batch.target, batch.norm
    h1 = np.maximum(z1, 0.0)
    cut = np.maximum((a1[t] - norm[:, None] * batch.x[s][:, None]) @ w1 + b1, 0.0)
    change = cut - h1[t]  # of node t when its edge is cut
    per_node = batch.nodes[batch.graph[t]]
    if weights.depth == 1:
        shift = change @ weights.head[0] / per_node
    else:
        w2, b2 = weights.layers[1]
        z2 = kept[1][1]
        h2 = np.maximum(z2, 0.0)
        moved = change @ w2
        # At t itself: the self-loop sees the change and the layer-2 message of s is gone.
        own = z2[t] + batch.loop[t][:, None] * moved - norm[:, None] * (h1[s] @ w2)
        shift = (np.maximum(own, 0.0) - h2[t]) @ weights.head[0]
        # Where t points to: every pair (cut edge, edge leaving t).
        order = np.argsort(s, kind="stable")
        first = np.searchsorted(s[order], t, "left")
        after = np.searchsorted(s[order], t, "right")
        reach = after - first
        for lo in _chunks(reach, REACH_ROWS):
            rows = np.repeat(np.arange(lo[0], lo[1]), reach[lo[0] : lo[1]])
            if not len(rows):
                continue
            start = np.repeat(np.cumsum(reach[lo[0]:lo[1]]) - reach[lo[0]:lo[1]],
                              reach[lo[0]:lo[1]])
            leaving = order[first[rows] + np.arange(len(rows)) - start]
            end = t[leaving]
            carried = (batch.copies * norm)[leaving][:, None]
            new = np.maximum(z2[end] + carried * moved[rows], 0.0)
            shift += np.bincount(rows, (new - h2[end]) @ weights.head[0], len(shift))
        shift = shift / per_node
    g = batch.graph[t]
    lost = np.maximum(0.0, p[g] - _sigmoid(logit[g] + shift))
    return np.where(batch.edge_row >= 0, np.append(lost, 0.0)[batch.edge_row], 0.0)


def _chunks(sizes, limit):
    """Ranges of consecutive rows whose sizes sum to about ``limit``."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)
