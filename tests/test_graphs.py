import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowverdict.operators import explain as ex, gcn, graph_batch as gb, graphs as g

HAND = [("t1", 0, "/a", "/b"), ("t1", 1, "/a", "/b"), ("t1", 2, "/b", "/b")]
SCHEMA = "trace_id string, pos long, from_id string, to_id string"


def _random_edges(seed=3, graphs=12):
    rng = random.Random(seed)
    rows = []
    for t in range(graphs):
        v = rng.randrange(1, 9)
        rows += [(f"t{t}", i, f"/n{rng.randrange(v)}", f"/n{rng.randrange(v)}")
                 for i in range(rng.randrange(1, 30))]
    return rows


def test_hand_answers(spark):
    df = spark.createDataFrame(HAND, SCHEMA)
    assert {r["node_id"]: r["x"] for r in g.node_degrees(df).collect()} == {"/a": 2.0, "/b": 4.0}
    listed = spark.createDataFrame([("t1",), ("t2",)], "trace_id string")
    got = {r[0]: tuple(r)[1:] for r in g.graph_statistics(df, listed).collect()}
    assert got == {"t1": (3, 2, 2, 1), "t2": (0, 0, 0, 0)}
    top = {r[0]: tuple(r)[1:] for r in g.topology_features(df, listed).collect()}
    assert top == {"t1": (0.5, 1.0, 0.0), "t2": (0.0, 0.0, 0.0)}


def test_topology_by_brute_force(spark):
    rows = _random_edges()
    got = {r["trace_id"]: r for r in g.topology_features(spark.createDataFrame(rows, SCHEMA))
           .collect()}
    for t in {r[0] for r in rows}:
        mine = {(a, b) for x, _, a, b in rows if x == t}
        nodes = {n for e in mine for n in e}
        simple = {(a, b) for a, b in mine if a != b}
        near = {n: {b for a, b in simple if a == n} | {a for a, b in simple if b == n}
                for n in nodes}
        local = []
        for n in nodes:
            pairs = list(itertools.combinations(near[n], 2))
            local.append(sum(b in near[a] for a, b in pairs) / len(pairs) if pairs else 0.0)
        v = len(nodes)
        assert got[t]["avg_clustering"] == pytest.approx(sum(local) / v)
        assert got[t]["graph_density"] == pytest.approx(len(simple) / (v * (v - 1)) if v > 1 else 0)
        most = max((sum(b == n for _, b in simple) for n in nodes), default=0)
        assert got[t]["max_in_degree"] == most


def _dense_probability(edges, w, masked=None):
    """Plain matrix form of the net; ``masked`` drops one copy of one message."""
    names = sorted({n for e in edges for n in e})
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names),) * 2)
    x = np.zeros(len(names))
    for s, t in edges:
        x[at[s]] += 1
        x[at[t]] += 1
        if s != t:
            a[at[t], at[s]] += 1
    a += np.eye(len(names))
    d = a.sum(1)
    m = a / np.sqrt(np.outer(d, d))
    if masked is not None and masked[0] != masked[1]:
        i, j = at[masked[1]], at[masked[0]]
        m[i, j] -= 1 / np.sqrt(d[i] * d[j])
    h = x[:, None]
    for wk, bk in w.layers:
        h = np.maximum(m @ h @ wk + bk, 0)
    return 1 / (1 + np.exp(-(h.mean(0) @ w.head[0] + w.head[1])))


def _weights(depth, seed=1):
    w = gb.initial_weights(6, depth, seed)
    rng = np.random.default_rng(seed)
    return w.like(w.flat() + rng.normal(0, 0.1, w.flat().size))


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_scores_in_all_forms(spark, depth):
    rows = _random_edges()
    df = spark.createDataFrame(rows, SCHEMA)
    w = _weights(depth)
    arrays = {r["trace_id"]: r["gcn_prob"] for r in gcn.score_edges(df, w).collect()}
    joined = {r["trace_id"]: r["gcn_prob"] for r in gcn.score_edges(df, w, task_edges=2).collect()}
    assert arrays.keys() == joined.keys() == {r[0] for r in rows}
    for t, p in arrays.items():
        want = _dense_probability([(a, b) for x, _, a, b in rows if x == t], w)
        assert p == pytest.approx(want) and joined[t] == pytest.approx(want)


def test_empty_graphs_score_zero_and_fallback(spark):
    rows = [("a", [("/x", "/y")], True), ("b", [], True), ("c", [("/x", "/y")], False),
            ("d", None, False)]
    df = spark.createDataFrame(
        rows, "_id string, call_graph array<struct<fromId:string,toId:string>>, "
              "has_features boolean")
    two, one = _weights(2), _weights(1)
    got = {r["_id"]: r["gcn_prob"]
           for r in gcn.score_call_graphs(df, two, fallback=one).collect()}
    assert got["b"] == 0.0 and got["d"] == 0.0
    assert got["a"] == pytest.approx(_dense_probability([("/x", "/y")], two))
    assert got["c"] == pytest.approx(_dense_probability([("/x", "/y")], one))


@pytest.mark.parametrize("depth", [1, 2])
def test_edge_importance_by_brute_force(spark, depth):
    rows = _random_edges(8)
    w = _weights(depth, 4)
    graphs = g.collect_graphs(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed(
        "_id", "trace_id")
    got = ex.explain_graph(graphs, w).collect()
    assert len(got) == len(rows)
    for r in got:
        edges = [(a, b) for x, _, a, b in rows if x == r["trace_id"]]
        drop = _dense_probability(edges, w) - _dense_probability(
            edges, w, (r["from_id"], r["to_id"]))
        assert r["importance"] == pytest.approx(max(0.0, drop), abs=1e-12)


@pytest.mark.parametrize("depth", [1, 2])
@pytest.mark.parametrize("task_edges", [0, 8, 1000])
def test_edges_of_large_graphs_by_joins(spark, depth, task_edges):
    """Joined, in tasks, or both, by the size of a graph: the same as leaving edges out."""
    rows = _random_edges(8)
    rows += [("hub", k, f"/s{k % 5}" if k < 30 else "/hub", "/hub" if k < 30 else f"/e{k % 7}") for k in range(60)]
    rows += [("hub", 60, "/hub", "/hub"), ("loop", 0, "/a", "/a")]
    w = _weights(depth, 4)
    got = ex.explain_edges(spark.createDataFrame(rows, SCHEMA), w, task_edges).collect()
    assert sorted((r["trace_id"], r["pos"]) for r in got) == sorted(r[:2] for r in rows)
    for r in got:
        edges = [(a, b) for x, _, a, b in rows if x == r["trace_id"]]
        drop = _dense_probability(edges, w) - _dense_probability(
            edges, w, (r["from_id"], r["to_id"]))
        want = 0.0 if r["from_id"] == r["to_id"] else max(0.0, drop)
        assert r["importance"] == pytest.approx(want, abs=1e-12)


def test_a_hub_costs_its_kinds_of_edges(spark):
    """20,000 edges into and 20,000 out of one node: 400 million pairs, but few kinds."""
    w = _weights(2, 4)
    n = 20_000
    edges = spark.range(2 * n).selectExpr(
        "'h' AS trace_id", "id AS pos", f"if(id < {n}, concat('/s', id), '/hub') AS from_id",
        f"if(id < {n}, '/hub', concat('/e', id)) AS to_id")
    got = {r["k"]: r for r in ex.explain_edges(edges, w, 10).groupBy(
        (F.col("from_id") == "/hub").alias("k")).agg(
            F.count(F.lit(1)).alias("n"), F.min("importance").alias("low"), F.max("importance").alias("high")).collect()}
    for leaves in (True, False):
        assert got[leaves]["n"] == n and got[leaves]["high"] == pytest.approx(got[leaves]["low"], abs=1e-12)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_gradients_by_differences(depth):
    rows = _random_edges(2, 5)
    lists = [[{"fromId": a, "toId": b} for x, _, a, b in rows if x == f"t{t}"] for t in range(5)]
    batch = gb.make_batch(pa.array(lists))
    y, w = np.array([0, 1, 1, 0, 1.0]), _weights(depth)
    flat = w.flat()
    grad = gb.gradients(batch, w, y, 2.5)[0]
    for i in range(0, flat.size, 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (gb.gradients(batch, w.like(flat + s * step), y, 2.5)[1] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fit_lowers_the_loss(spark):
    rows = [(f"g{i}", [("/a", "/b")] * (1 + i % 2 * 6) + [("/b", f"/c{i % 3}")], i % 2)
            for i in range(40)]
    df = spark.createDataFrame(
        rows, "_id string, call_graph array<struct<fromId:string,toId:string>>, y int")
    w = gcn.fit_gcn(df, hidden=8, depth=2, epochs=12, rate=0.05, batches=2)
    out = gcn.score_call_graphs(df, w).collect()
    right = sum((r["gcn_prob"] > 0.5) == (r["y"] == 1) for r in out)
    assert right >= 38
    again = gcn.fit_gcn(df, hidden=8, depth=2, epochs=12, rate=0.05, batches=2)
    assert np.allclose(w.flat(), again.flat())


def labelled_graphs(spark, n):
    rows = [(f"g{i}", [("/a", "/b")] * (1 + i % 2 * 6) + [("/b", f"/c{i % 3}")] * (i % 4), i % 2)
            for i in range(n)]
    return spark.createDataFrame(
        rows, "_id string, call_graph array<struct<fromId:string,toId:string>>, y int")


def plain_fit(sharded, nets, epochs, batch, factor, seed=42):
    """Epochs of Adam per shard, one batch after another, then averages by graphs."""
    rows = {}
    for r in sharded.collect():
        rows.setdefault(r["shard"], []).append((r["place"], [tuple(e) for e in r["call_graph"]], r["y"]))
    total = sum(map(len, rows.values()))
    out = []
    for net in nets:
        start = gb.initial_weights(net.hidden, net.depth, seed)
        flat, m, v, t = start.flat(), 0.0, 0.0, 0.0
        for epoch in range(1, epochs + 1):
            ends = []
            for shard, held in rows.items():
                held = sorted(held, key=lambda r: r[0])
                x, mm, vv, tt = flat, m, v, t
                order = np.random.default_rng([seed, epoch, shard]).permutation(len(held))
                for low in range(0, len(order), batch):
                    part = [held[k] for k in order[low : low + batch]]
                    lists = [[{"fromId": a, "toId": b} for a, b in g] for _, g, _ in part]
                    y = np.array([float(r[2]) for r in part])
                    g, _, n = gb.gradients(gb.make_batch(pa.array(lists)), start.like(x), y, factor)
                    tt += 1
                    mm = 0.9 * mm + 0.1 * g / n
                    vv = 0.999 * vv + 0.001 * (g / n) ** 2
                    x = x - net.rate * (mm / (1 - 0.9**tt)) / (np.sqrt(vv / (1 - 0.999**tt)) + 1e-8)
                ends.append((len(held) / total, x, mm, vv, tt))
            flat, m, v, t = (sum(e[0] * e[k] for e in ends) for k in (1, 2, 3, 4))
        out.append(flat)
    return out


@pytest.mark.parametrize("graphs_a_shard", [1000, 12])
def test_fit_is_plain_adam_averaged_over_shards(spark, monkeypatch, graphs_a_shard):
    monkeypatch.setattr(gcn, "SHARD_GRAPHS", graphs_a_shard)
    df = labelled_graphs(spark, 70)
    nets = [gcn.Net(5, 2, 0.01), gcn.Net(3, 1, 0.05)]
    sharded, total, positive = gcn.training_shards(df, 42, 8)
    assert sharded.select("shard").distinct().count() == (1 if graphs_a_shard == 1000 else 6)
    factor = (total - positive) / (positive + 1e-5)
    want = plain_fit(sharded, nets, 3, 8, factor)
    got = gcn.fit_gcns(df, nets, 3, "balanced", batch=8)
    for w, flat in zip(got, want):
        assert np.allclose(w.flat(), flat, rtol=0, atol=1e-9)
    again = gcn.fit_gcns(df.repartition(5), nets, 3, "balanced", batch=8, snapshots=[1, 3])
    assert np.allclose(again[3][0].flat(), want[0], rtol=0, atol=1e-9)
    assert not np.allclose(again[1][0].flat(), want[0], atol=1e-4)


def test_jobs_of_a_fit_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(gcn, "SHARD_GRAPHS", 10)
    context, jobs = spark.sparkContext, []
    for n, nets in ((20, 1), (200, 3)):
        context.setJobGroup(f"fit{n}", "")
        gcn.fit_gcns(labelled_graphs(spark, n), [gcn.Net(4, 1)] * nets, 2)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit{n}")))
    context.setJobGroup("", "")
    assert jobs[0] == jobs[1] < 20


def test_search_judges_every_cell(spark):
    df = labelled_graphs(spark, 40)
    grid = {"hidden_channels": [4, 6], "learning_rate": [0.01, 0.1]}
    out = {r["cell"]: r for r in gcn.search_gcn(df, df, grid, epochs=4).collect()}
    assert sorted(out) == [0, 1, 2, 3]
    for cell, (hidden, rate) in enumerate([(4, 0.01), (4, 0.1), (6, 0.01), (6, 0.1)]):
        w = gcn.fit_gcn(df, hidden, 2, 4, rate)
        scored = gcn.score_call_graphs(df, w).collect()
        right = sum(r["gcn_prob"] > 0.5 and r["y"] == 1 for r in scored)
        assert (out[cell]["hidden_channels"], out[cell]["learning_rate"]) == (hidden, rate)
        assert out[cell]["tp"] == right
    by_epochs, kept = gcn.search_epochs(df, df, [2, 4], hidden=4, rate=0.1)
    rows = {r["cell"]: r for r in by_epochs.collect()}
    assert sorted(rows) == [2, 4] == sorted(kept)
    assert [rows[4][c] for c in ("tn", "fp", "fn", "tp")] == [out[1][c] for c in ("tn", "fp", "fn", "tp")]


def test_fit_without_graphs(spark):
    df = labelled_graphs(spark, 4).where("y > 5")
    assert np.allclose(gcn.fit_gcn(df, 4).flat(), gb.initial_weights(4).flat())
