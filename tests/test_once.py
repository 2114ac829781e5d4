"""Work that is done once, however often its result is read."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowverdict.operators import (
    forest as fo, gate as gt, gcn, graph_batch as gb, grids, neighbours as nb,
)
from flowverdict.plans import compare
from flowverdict.schemas import CATEGORICAL, MODEL_INPUT


def test_forest_balances_its_rows_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        def rows(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return x.repartition(2).mapInArrow(rows, x.schema).repartition(2)

    monkeypatch.setattr(fo, "smote", counted)
    columns = [F.lit("a").alias(n) if n in CATEGORICAL else (F.col("id") % (k + 2)).cast("double").alias(n)
               for k, n in enumerate(MODEL_INPUT)]
    kind = F.when(F.col("id") % 3 == 0, "outlier").otherwise("normal").alias("classification")
    rows = spark.range(60).select(F.col("id").cast("string").alias("_id"), *columns, kind)
    fo.train_forest(rows, trees=2, depth=2)
    assert seen.value == 60


def test_a_batch_is_sorted_once_for_all_layers_and_nets(monkeypatch):
    made = []

    class Sums(gb._Sums):
        def __init__(self, *args, **named):
            made.append(1)
            super().__init__(*args, **named)

    monkeypatch.setattr(gb, "_Sums", Sums)
    graph = [{"fromId": a, "toId": b} for a, b in ("ab", "bc", "ca", "ab")]
    kind = pa.list_(pa.struct([("fromId", pa.string()), ("toId", pa.string())]))
    batch = gb.make_batch(pa.array([graph, [], graph[:2]], kind))
    for depth in (1, 2, 3):
        gb.gradients(batch, gb.initial_weights(4, depth), np.array([1.0, 0.0, 0.0]))
    assert len(made) == 3


def test_blocks_of_vectors_are_dealt_to_several_tasks(spark, monkeypatch):
    """And only neighbours that can be among the nearest leave a visited block."""
    monkeypatch.setattr(nb, "CELL_ROWS", 40)
    tasks, plain = [], nb._tasks
    monkeypatch.setattr(nb, "_tasks", lambda n: tasks.append(plain(n)) or tasks[-1])
    x = np.random.default_rng(5).normal(size=(400, 3))
    vectors = spark.createDataFrame([(v.tolist(), 1) for v in x], "x array<double>, m bigint")
    found = {tuple(r["x"]): [n["d"] for n in r["near"]] for r in nb.nearest_vectors(vectors, 3).collect()}
    assert tasks[0] == 10 and len(tasks) == 2
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    for v, d in zip(x, np.sort(far, axis=1)[:, :3]):
        np.testing.assert_allclose(found[tuple(v)], d)


def test_a_task_adds_up_its_shards(spark, monkeypatch):
    """The weights are those of shards in tasks of their own, from fewer rows."""
    monkeypatch.setattr(gcn, "SHARD_GRAPHS", 8)
    graphs = spark.range(100).select(
        F.col("id").cast("string").alias("_id"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda k: F.struct(
            k.cast("string").alias("fromId"), ((k * 7 + F.col("id")) % 4).cast("string").alias("toId"))
        ).alias("call_graph"), (F.col("id") % 2).cast("int").alias("y"))
    plain, rows = gcn._added, []
    monkeypatch.setattr(gcn, "_added", lambda parts, size: rows.append(parts.count() // size) or plain(parts, size))
    found = []
    for least, shards in ((1, 8), (1000, 1)):
        monkeypatch.setattr(gcn, "LEAST_TASKS", least)
        monkeypatch.setattr(gcn, "TASK_SHARDS", shards)
        found.append(gcn.fit_gcn(graphs, hidden=4, epochs=2, batch=4).flat())
    assert rows[0] <= 2 < rows[-1]
    np.testing.assert_allclose(*found, rtol=1e-12, atol=1e-15)


def test_a_shard_is_laid_out_once(monkeypatch):
    """Batches picked from it give the gradients of batches laid out alone, larger graphs included."""
    rng = np.random.default_rng(3)
    lists = [[{"fromId": str(a), "toId": str(b)} for a, b in rng.integers(0, n, (2 * n, 2))]
             for n in (3, 100, 1, 70, 8, 5)] + [[]]
    graphs = pa.array(lists, pa.list_(pa.struct([("fromId", pa.string()), ("toId", pa.string())])))
    whole, y = gb.make_batch(graphs), np.array([1.0, 0, 1, 0, 0, 1, 0])
    for rows in ([6, 3, 0, 4], [1, 2], [5, 4, 3, 2, 1, 0], [6]):
        alone = gb.make_batch(graphs.take(pa.array(rows)))
        h = rng.normal(size=(whole.nodes[rows].sum(), 4))
        picked = whole.picked(np.array(rows))
        plain = np.diag(picked.loop)
        np.add.at(plain, (picked.target, picked.source), picked.copies * picked.norm)
        np.testing.assert_allclose(picked.messages(h), plain @ h, atol=1e-12)
        np.testing.assert_allclose(picked.messages(h, back=True), plain.T @ h, atol=1e-12)
        for depth in (1, 2, 3):
            w = gb.initial_weights(4, depth)
            for a, b in zip(gb.gradients(picked, w, y[rows], 2.0), gb.gradients(alone, w, y[rows], 2.0)):
                np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    made, plain_batch = [], gcn.make_batch
    monkeypatch.setattr(gcn, "make_batch", lambda *a: made.append(1) or plain_batch(*a))
    table = pa.table({"shard": [0] * 6, "call_graph": graphs[:6], "y": y[:6]})  # all with edges
    shapes = [gb.initial_weights(4, d) for d in (1, 3)]
    states = [np.concatenate([w.flat(), np.zeros(2 * w.flat().size + 1)]) for w in shapes]
    ends = []
    for most in (gcn.LAID_OUT_EDGES, 0):
        monkeypatch.setattr(gcn, "LAID_OUT_EDGES", most)
        ends.append(gcn.local_steps(table, states, shapes, [0.01, 0.01], 2, 1.0, 42, 1))
        assert len(made) == (1 if most else 4)
    for a, b in zip(*ends):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)


def test_a_sweep_scores_its_splits_once(spark, monkeypatch):
    """All epoch counts share the scores of a split and the jobs of the gates, and are judged as
    each would be alone."""
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("_id"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda k: F.struct(
            k.cast("string").alias("fromId"), ((k * 7 + F.col("id")) % 4).cast("string").alias("toId"))
        ).alias("call_graph"))
    scored, jobs, plain = [], [], gt.summed
    runs = {n: [gb.initial_weights(4, d, n) for d in (1, 2)] for n in (2, 3, 5)}

    def forest(df):
        scored.append(1)
        return df.withColumn("rf_prob", F.col("_id").cast("int") * 31 % 97 / 97.0)

    monkeypatch.setattr(gt, "summed", lambda *a: jobs.append(1) or plain(*a))
    monkeypatch.setattr(compare, "train_forest", lambda *a, **k: forest)
    monkeypatch.setattr(compare, "fit_gcns", lambda *a, **k: runs)
    spaces = {"strategy1": {k: v[:2] for k, v in grids.STRATEGY1.items()},
              "strategy2": grids.STRATEGY2, "dual": {k: v[:2] for k, v in grids.DUAL.items()}}
    out = compare.sweep_epochs(rows, rows, rows, [2, 3, 5], (1, 2), spaces=spaces, gate_epochs=3)
    found = {(r["epochs"], r["method"]): r for r in out.collect()}
    assert len(found) == 24 and len(scored) == 2 and len(jobs) == 3
    alone = compare.judge_methods(rows, rows, forest, dict(zip((1, 2), runs[3])), spaces, 3)
    for r in alone.collect():
        assert found[3, r["method"]].asDict() == r.asDict() | {"epochs": 3}
