import numpy as np
import pytest
from pyspark.sql import functions as F

from flowverdict.operators import (
    explain as ex, forest as fo, gate as gt, grow, neighbours, prepare as pr, smote as sm,
)
from flowverdict.plans import detect
from flowverdict.schemas import MODEL_INPUT
from flowverdict.sources import models as store
from flowverdict.sources.verdicts import VerdictStore


def _points(spark, seed=0, n=300, copies=40):
    """Minority points in clumps; one vector is held by many rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    x[:copies] = x[0]
    rows = [(f"m{i}", [float(v) for v in p], 1) for i, p in enumerate(x)]
    rows += [(f"n{i}", [float(v) for v in rng.normal(size=3)], 0) for i in range(2 * n + 17)]
    return spark.createDataFrame(rows, "_id string, x array<double>, y int"), x


@pytest.mark.parametrize("cell", [4000, 25])
def test_neighbours_are_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "VISITS_PER_GROUP", 50)
    df, x = _points(spark)
    vectors = df.where("y = 1").groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    distinct = np.unique(x, axis=0)
    got = neighbours.nearest_vectors(vectors, 4).collect()
    assert len(got) == len(distinct) and sum(r["m"] for r in got) == len(x)
    for r in got:
        d = np.sort(((distinct - np.array(r["x"])) ** 2).sum(1))[1:5]
        assert np.allclose([e["d"] for e in r["near"]], d)


def test_smote(spark):
    df, x = _points(spark)
    out = sm.smote(df).collect()
    made = [r for r in out if "~" in r["_id"]]
    sizes = {y: sum(r["y"] == y for r in out) for y in (0, 1)}
    assert sizes[0] == sizes[1] == 617 and len({r["_id"] for r in out}) == len(out)
    by_id = {f"m{i}": p for i, p in enumerate(x)}
    for r in made:
        seed = by_id[r["_id"].split("~")[0]]
        d = np.sqrt(((x - seed) ** 2).sum(1))
        far = np.sort(d)[5]  # itself first, then the five nearest
        assert np.linalg.norm(np.array(r["x"]) - seed) <= far + 1e-9
    assert sorted(map(str, out)) == sorted(map(str, sm.smote(df).collect()))


def test_codes_and_scaler(spark):
    df = spark.createDataFrame([("b", 1.0, 5.0), ("a", 3.0, 5.0), (None, 5.0, 5.0)],
                               "k string, v double, w double")
    codes = pr.fit_label_codes(df, ["k"])
    assert sorted((r["value"], r["code"]) for r in codes.collect()) == [("a", 0), ("b", 1)]
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "k string")
    assert [r["k"] for r in pr.apply_label_codes(new, codes, ["k"]).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="unseen value"):
        pr.apply_label_codes(new, codes, ["k"], handle_unseen="error").collect()
    scaler = pr.fit_scaler(df, ["v", "w"])
    assert scaler.mean == [3.0, 5.0] and scaler.scale[1] == 1.0
    assert scaler.scale[0] == pytest.approx(np.std([1, 3, 5]))
    assert [r["w"] for r in pr.apply_scaler(df, scaler).collect()] == [0.0] * 3


def test_many_codes_are_joined(spark, monkeypatch):
    monkeypatch.setattr(pr, "MAX_CODES", 2)
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    out = pr.apply_label_codes(df, pr.fit_label_codes(df, ["k"]), ["k"])
    assert sorted(r["k"] for r in out.collect()) == [0.0, 1.0, 2.0]


def test_preparation_with_many_codes(spark, monkeypatch, tmp_path):
    """Beyond the literal maps the codes are a table that is joined, with the same input."""
    rows = [(f"v{k % 7}", f"w{k % 3}", float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, n double")
    outs = []
    for most in (10_000, 3):
        monkeypatch.setattr(pr, "MAX_CODES", most)
        p = pr.fit_preparation(df, ["n"], ["a", "b"])
        assert isinstance(p.codes, dict) == (most > 3)
        new = spark.createDataFrame([("v3", "w1", 2.0), ("zz", None, 3.0)], "a string, b string, n double")
        outs.append(sorted((r["n"], r["x"]) for r in p.apply(new).collect()))
    assert outs[0] == outs[1]


@pytest.mark.parametrize("regions", [1, 5, 1024])
def test_neighbours_of_crowded_vectors(spark, monkeypatch, regions):
    """Far and near clumps: exact for any number of regions, and far blocks are not visited."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "REGIONS", regions)
    monkeypatch.setattr(neighbours, "VISITS_PER_GROUP", 40)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 4)) * 0.01 + 100 * c for c in rng.normal(size=(6, 4))]
                       + [rng.normal(size=(90, 4)) * 50])
    df = spark.createDataFrame([([float(v) for v in p], 1) for p in x], "x array<double>, m long")
    for r in neighbours.nearest_vectors(df, 3).collect():
        far = np.sort(((x - np.array(r["x"])) ** 2).sum(1))[1:4]
        assert [v["d"] for v in r["near"]] == pytest.approx(far.tolist())


def test_gate_gradient_and_form(spark):
    rng = np.random.default_rng(3)
    rf, gcn, y = rng.random(50), rng.random(50), rng.integers(0, 2, 50).astype(float)
    for net in ("small", "extended"):
        gate = gt.initial_gate(gt.NETS[net], 5)
        flat = gt._flat(gate)
        grad = gt.gate_gradients(rf, gcn, y, gate)[0]
        for i in range(0, flat.size, 11):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            up, down = (gt.gate_gradients(rf, gcn, y, gt._like(gate, flat + s * step))[1]
                        for s in (1, -1))
            assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)
        h = gt._inputs(rf, gcn, gate[0][0].shape[0])
        for k, (w, b) in enumerate(gate):
            h = h @ w + b
            h = np.maximum(h, 0) if k < len(gate) - 1 else 1 / (1 + np.exp(-h))
        df = spark.createDataFrame(
            [(float(a), float(b)) for a, b in zip(rf, gcn)] + [(None, 0.5)],
            "rf_prob double, gcn_prob double")
        got = [r["alpha"] for r in gt.score_gate(df, gate).collect()]
        assert np.allclose(got[:-1], h[:, 0]) and got[-1] is None


def test_gate_learns_and_stops(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    rf = np.where(y == 1, 0.9, 0.1)
    rows = [(float(a), float(b), int(t)) for a, b, t in zip(rf, 1 - rf, y)]
    df = spark.createDataFrame(rows, "rf_prob double, gcn_prob double, y int")
    gate = gt.fit_gate(df, epochs=60, validation=df, patience=10)
    out = gt.score_gate(df, gate).where("gate_verdict = y").count()
    assert out == 200


@pytest.fixture(scope="module")
def models(spark, folder):
    from catalog.learning import models
    return models(spark, folder)


def test_models_saved_and_loaded(spark, folder, models, tmp_path):
    from catalog.learning import graph_rows
    from catalog.traffic import features
    store.save_models(models, spark, str(tmp_path / "m"))
    again = store.load_models(spark, str(tmp_path / "m"))
    rows = features(spark, folder).withColumn("copies", F.lit(1))
    outs = []
    for m in (models, again):
        scored, _ = detect.detect_batch(rows, graph_rows(spark, folder), m, 1)
        outs.append(sorted(scored.select("trace_id", "rf_prob", "gcn_prob", "final_prob",
                                         "is_anomaly").collect()))
    assert outs[0] == outs[1] and outs[0]


def test_graph_only_task(spark, folder, models):
    from catalog.learning import graph_rows
    graphs = graph_rows(spark, folder)
    scored, skipped = detect.detect_batch(None, graphs, models, 1)
    assert scored.count() == 0 and skipped.count() == graphs.count()
    scored, skipped = detect.detect_batch(None, graphs, models, 1, allow_graph_only=True)
    assert skipped.count() == 0
    assert {r["mode"] for r in scored.select("mode").distinct().collect()} == {"gcn_only"}
    assert scored.where("features_json IS NOT NULL").count() == 0


def test_local_weights_follow_a_linear_model(spark, folder, models):
    """A linear scorer has the same slope everywhere, which the explanation must find."""
    from catalog.traffic import features
    rows = features(spark, folder).limit(3).withColumnRenamed("_id", "trace_id")
    slope = [0.05 * (i - 4) for i in range(len(MODEL_INPUT))]

    def linear(df):
        terms = [F.get("x", F.lit(i)) * F.lit(s) for i, s in enumerate(slope)]
        return df.withColumn("rf_prob", sum(terms, F.lit(0.5)))

    out = ex.explain_forest(rows, models.forest, samples=3000, model=linear)
    for r in out.collect():
        want = slope[MODEL_INPUT.index(r["feature"])]
        assert r["weight"] == pytest.approx(want, abs=0.02)
    top = ex.top_weights(out).collect()
    assert len(top) == 15 and {r["feature"] for r in top if r["rank"] <= 2} == {
        MODEL_INPUT[0], MODEL_INPUT[8]}


def test_local_weights_are_those_of_a_plain_solver(spark, folder, models):
    """Row by row, with weighted least squares and a ridge; and the forest scores every point
    once."""
    from catalog.traffic import features
    rows = features(spark, folder).orderBy("_id").limit(30).withColumnRenamed("_id", "trace_id")
    scored = []

    def bent(df):
        scored.append(df)
        x = [F.get("x", F.lit(i)) for i in range(len(MODEL_INPUT))]
        return df.withColumn("rf_prob", 1.0 / (1.0 + F.exp(-(x[0] * x[1] + F.sin(x[2]) - x[8]))))

    got = {(r["trace_id"], r["feature"]): r["weight"]
           for r in ex.explain_forest(rows, models.forest, samples=200, model=bent).collect()}
    assert sorted(df.count() for df in scored) == [30, 200]
    mine, shared = (bent(df).collect() for df in list(scored))
    d = len(MODEL_INPUT)
    for r in mine:
        z = np.array([r["x"], *[s["x"] for s in shared]])
        y = np.array([r["rf_prob"], *[s["rf_prob"] for s in shared]])
        w = np.sqrt(np.exp(-((z - z[0]) ** 2).sum(1) / (0.75**2 * d)))
        z = np.hstack([np.ones((len(z), 1)), z])
        ridge = np.diag([0.0] + [ex.RIDGE] * d)
        want = np.linalg.solve(z.T @ (w[:, None] * z) + ridge, z.T @ (w * y))[1:]
        for name, value in zip(models.forest.preparation.columns, want):
            assert got[r["trace_id"], name] == pytest.approx(value, abs=1e-9)


def test_explanations_of_stored_records(spark, models):
    rows = [
        ("a", "{}", '[{"fromId":"/x","toId":"/y"},{"fromId":"/y","toId":"/z"}]'),
        ("b", '{"sequence_length(count)": 3.0, "ip_type": "default"}', None),
        ("c", '{"sequence_length(count)": 3.0}', '[{"fromId":"/x","toId":"/x"}]'),
    ]
    stored = spark.createDataFrame(
        rows, "trace_id string, features_json string, call_graph_json string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("zz",)], "trace_id string")
    out = {r["trace_id"]: r for r in ex.explain_batch(
        asked, stored, models.forest, models.gcn, models.fallback, 50).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"]["lime_weights"] == {} and len(out["b"]["lime_weights"]) == 5
    assert out["b"]["abnormal_edges"] == [] and out["c"]["abnormal_edges"] == []
    assert all(e["importance"] > 0 for e in out["a"]["abnormal_edges"])


def test_a_block_meets_few_vectors_at_a_time():
    assert neighbours.VISITS_PER_GROUP <= 2 * neighbours.CELL_ROWS


@pytest.mark.parametrize("job", ["score", "explain"])
def test_many_graphs_take_little_memory(job):
    """A batch of 10,000 graphs is worked off in pieces: a piece holds 64 numbers an edge."""
    import tracemalloc

    from flowverdict.operators import gcn
    import pyarrow as pa
    from flowverdict.operators import graph_batch as gb
    rng = np.random.default_rng(1)
    ends = [pa.array([f"/{k}" for k in rng.integers(0, 50, 120_000)]) for _ in range(2)]
    edges = pa.StructArray.from_arrays(ends, ["fromId", "toId"])
    graphs = pa.ListArray.from_arrays(pa.array(np.arange(0, 120_001, 12, dtype=np.int32)), edges)
    weights = gb.initial_weights(64, 2)

    def one(piece):
        batch = gb.make_batch(piece)
        return gb.forward(batch, weights)[0] if job == "score" else gb.edge_importance(batch, weights)[batch.listed]

    tracemalloc.start()
    parts = [one(p) for p in gcn._pieces(graphs, gcn.graph_lengths(graphs))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (250e6 if job == "score" else 400e6)
    assert np.allclose(np.concatenate(parts), one(graphs), rtol=0, atol=1e-12)


def test_forest_importances(spark, models):
    rows = fo.feature_importances(models.forest, spark).collect()
    assert sorted(r["feature"] for r in rows) == sorted(MODEL_INPUT)
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_gates_of_many_seeds_are_those_of_one(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{k}", float(a), float(b), int(a + b > 1)) for k, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "trace_id string, rf_prob double, gcn_prob double, y int")
    train, val, test = (df.where(f"int(substr(trace_id, 2)) % 3 = {k}") for k in range(3))
    together = gt.fit_gates(train, [1, 2], epochs=8, validation=val, patience=3)
    for seed, gate in zip((1, 2), together):
        alone = gt.fit_gate(train, epochs=8, seed=seed, validation=val, patience=3)
        assert np.allclose(gt._flat(alone), gt._flat(gate), atol=1e-9)
    from flowverdict.plans import compare
    metrics, spread, drift, shared = compare.gate_stability(train, val, test.unionByName(val.limit(4)), 3, 6)
    got = {r["run"]: r for r in metrics.collect()}
    assert sorted(got) == [1, 2, 3] and all(r["normal_count"] + r["anomaly_count"] == 104 for r in got.values())
    assert spread.first()["f1_max"] == max(r["f1"] for r in got.values())
    assert {r["split"] for r in drift.collect()} == {"train", "val", "test"}
    assert 4 in shared.first().asDict().values()


def test_a_stopped_gate_is_not_measured(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a + b > 1)) for a, b in rng.random((80, 2))]
    df = spark.createDataFrame(rows, "rf_prob double, gcn_prob double, y int")
    real, sizes = gt.summed, []
    monkeypatch.setattr(gt, "summed", lambda df, call, size: sizes.append(size) or real(df, call, size))
    gates = gt.fit_gates(df.where("rf_prob < 0.6"), [1, 2, 3], epochs=60, rate=0.2, validation=df, patience=2)
    assert len(gates) == 3 and sizes[0] == max(sizes) and min(sizes) < sizes[0]
    gate, (rf, gcn, y) = gates[0], np.array(rows).T
    assert gt.gate_loss(rf, gcn, y, gate) == gt.gate_gradients(rf, gcn, y, gate)[1:]


def test_training_job(spark, folder):
    from catalog.learning import graph_rows, labelled_sessions
    from flowverdict.plans import train
    rows = labelled_sessions(spark, folder).drop("y")
    models, report, ranked = train.train_models(rows, graph_rows(spark, folder), hidden=4, epochs=2, trees=5, depth=3)
    got = {r["model"]: r for r in report.collect()}
    assert set(got) == {"rf", "gcn", "fallback"} and got["rf"]["normal_count"] + got["rf"]["anomaly_count"] == rows.count()
    assert got["gcn"]["normal_count"] == got["fallback"]["normal_count"]
    assert (models.gcn.depth, models.fallback.depth) == (2, 1)
    assert [r["rank"] for r in ranked.collect()] == list(range(1, len(MODEL_INPUT) + 1))


def test_search_judges_cuts_of_one_forest(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([([float(v) for v in p], int(k)) for p, k in zip(x, y)], "x array<double>, y int")
    grid = {"n_estimators": [4, 7], "max_depth": [0, 2, 6], "max_features": ["sqrt", "log2"]}
    real, seen = fo.grown_trees, []
    monkeypatch.setattr(fo, "grown_trees", lambda *a: seen.append(real(*a)) or seen[-1])
    out = {(r["n_estimators"], r["max_depth"], r["max_features"]): r for r in fo.search_forest(df, df, grid).collect()}
    assert len(seen) == 2
    assert sorted(r["cell"] for r in out.values()) == list(range(12))
    model = fo.fit_forest(df, 7, 6, "sqrt")
    whole = real(model, spark).at_depths(x, [0, 2, 6])
    want = np.array([r["rf_prob"] for r in fo.forest_probability(df, model).collect()])
    assert np.allclose(whole[2].mean(axis=1), want)  # the uncut forest is the model
    for k in (0, 3):
        tree = [model.trees[k].predictProbability(Vectors.dense(p))[1] for p in x[:40]]
        assert np.allclose(whole[2][:40, k], tree)
    assert len(np.unique(whole[0][:, 0])) == 1 and len(np.unique(whole[1][:, 0])) <= 4
    whole = seen[0].at_depths(x, [0, 2, 6])
    for t in (4, 7):
        for k, d in enumerate((0, 2, 6)):
            guess = whole[k][:, :t].mean(axis=1) > 0.5
            assert out[t, d, "sqrt"]["tp"] == int((guess & (y == 1)).sum())
            assert out[t, d, "sqrt"]["fp"] == int((guess & (y == 0)).sum())


def test_search_grows_trees_in_groups_the_driver_can_hold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([([float(v) for v in p], int(k)) for p, k in zip(x, y)], "x array<double>, y int")
    grid = {"n_estimators": [3, 8], "max_depth": [2, 9], "max_features": ["sqrt"]}
    real, seen = fo.grown_trees, []
    monkeypatch.setattr(fo, "NODES_AT_ONCE", 600)
    monkeypatch.setattr(fo, "grown_trees", lambda *a: seen.append(real(*a)) or seen[-1])
    out = {(r["n_estimators"], r["max_depth"]): r for r in fo.search_forest(df, df, grid).collect()}
    sizes = [len(t.roots) for t in seen]
    assert sum(sizes) == 8 and sizes[0] == 1 and max(sizes) > 1
    assert all(len(t.feature) <= 900 or len(t.roots) == 1 for t in seen)  # about 600
    found = np.concatenate([t.at_depths(x, [2, 9]) for t in seen], axis=2)
    assert len(np.unique(found[1], axis=1).T) > 4  # the groups are not the same trees again
    for t in (3, 8):
        for k, d in enumerate((2, 9)):
            guess = found[k][:, :t].mean(axis=1) > 0.5
            assert out[t, d]["tp"] == int((guess & (y == 1)).sum())
            assert out[t, d]["fp"] == int((guess & (y == 0)).sum())


def _noisy(n, width, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return x, ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)


def _rows_of(spark, x, y):
    return spark.createDataFrame([([float(v) for v in p], int(k)) for p, k in zip(x, y)], "x array<double>, y int")


def test_search_of_a_larger_table_grows_and_judges_in_tasks(spark, monkeypatch):
    x, y = _noisy(700, 5, 4)
    train, val = _rows_of(spark, x[:400], y[:400]), _rows_of(spark, x[400:], y[400:])
    val = val.unionByName(val.limit(1).withColumn("y", F.lit(None).cast("int")))  # judged, not counted
    monkeypatch.setattr(fo, "SPARK_ROWS", 300)
    monkeypatch.setattr(fo, "fit_forest", lambda *a: pytest.fail("Spark's trainer walks all rows once a level"))
    grid = {"n_estimators": [3, 8], "max_depth": [0, 2, 9], "max_features": ["sqrt", "log2"]}
    real, seen = fo.binned, []  # the bag goes by the order in which the rows were read
    monkeypatch.setattr(fo, "binned", lambda *a, **k: seen.append((real(*a, **k), a[1])) or seen[-1][0])
    found = fo.search_forest(train, val, grid, seed=-7).collect()
    assert sorted(r["cell"] for r in found) == list(range(12))
    rows, borders = seen[0]
    trees = [grow.grown_tree(rows, 9, 3, np.random.default_rng([-7 & (2**63 - 1), k])) for k in range(8)]
    assert len({len(t.feature) for t in trees}) > 1

    def walk(tree, v, depth):
        at = 0
        for _ in range(depth):
            f = tree.feature[at]
            if f < 0:
                break
            at = (tree.left if v[f] <= borders[f][tree.threshold[at]] else tree.right)[at]
        return tree.probability[at]

    for r in found:  # both rules draw 3 of 5 features, from the same numbers
        p = np.mean([[walk(t, v, r["max_depth"]) for v in x[400:]] for t in trees[: r["n_estimators"]]], axis=0)
        assert (r["tp"], r["fp"]) == (int(((p > 0.5) & (y[400:] == 1)).sum()), int(((p > 0.5) & (y[400:] == 0)).sum()))
    # A table that no task can hold is left to the trainer.
    monkeypatch.setattr(fo, "TASK_BYTES", 100)
    with pytest.raises(pytest.fail.Exception):
        fo.search_forest(train, val, grid)


def test_trees_of_tasks_are_those_of_the_rules(spark):
    x, y = _noisy(500, 4, 6)
    df = _rows_of(spark, x, y)
    borders = grow.bin_borders(df)
    rows = grow.binned(df, borders)
    assert [len(b) for b in borders] == [31] * 4
    assert all((rows.bins[:, k] <= c).sum() == (x[:, k] <= b).sum() for k in range(4) for c, b in enumerate(borders[k]))
    w = np.random.default_rng(1).poisson(1.0, 500)

    def impurity(i):
        p = (w[i] * y[i]).sum() / max(w[i].sum(), 1)
        return w[i].sum() * 2 * p * (1 - p)

    def brute(i, depth):  # probability of every row by the best of all splits
        tried = [(impurity(i & low) + impurity(i & ~low), f, c) for f in range(4) for c in range(31)
                 for low in [rows.bins[:, f] <= c] if w[i & low].sum() and w[i & ~low].sum()]
        if not depth or not tried or impurity(i) == 0:
            return np.where(i, (w * y)[i].sum() / w[i].sum(), 0.0)
        _, f, c = min(tried)
        low = rows.bins[:, f] <= c
        return brute(i & low, depth - 1) + brute(i & ~low, depth - 1)

    tree = grow.grown_tree(rows, 2, 4, np.random.default_rng(1))
    want, got = brute(np.ones(500, bool), 2), tree.at_depths(rows.bins, [2])[0][:, 0]
    inner = np.flatnonzero(tree.feature >= 0)
    for k in inner:  # leaves of one verdict are one leaf
        a, b = tree.left[k], tree.right[k]
        assert tree.feature[a] >= 0 or tree.feature[b] >= 0 or (tree.probability[a] > 0.5) != (tree.probability[b] > 0.5)
    assert ((want > 0.5) == (got > 0.5)).all() and set(got) <= set(tree.probability)
    whole = grow.grown_tree(rows, 30, 4, np.random.default_rng(1))
    verdict = whole.at_depths(rows.bins, [30])[0][:, 0] > 0.5
    assert (verdict[w > 0] == (y[w > 0] == 1)).all()  # rows of the bag end in pure leaves
    assert len(grow.grown_tree(rows, 0, 4, np.random.default_rng(1)).feature) == 1


def test_task_trees_like_those_of_the_trainer(spark):
    x, y = _noisy(1500, 6, 8)
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 1.0  # few values, one value
    df = _rows_of(spark, x, y)
    borders = grow.bin_borders(df)
    levels = np.unique(x[:, 2])
    assert np.allclose(borders[2], (levels[:-1] + levels[1:]) / 2) and len(borders[3]) == 0
    rows = grow.binned(df, borders)
    sizes = [len(grow.grown_tree(rows, 12, 3, np.random.default_rng(k)).feature) for k in range(20)]
    trainer = [t.numNodes for t in fo.fit_forest(df, 20, 12).trees]
    assert np.mean(sizes) == pytest.approx(np.mean(trainer), rel=0.1)
    for bad, text in (([None, 1], "null"), ([[1.0, None] * 3, 1], "null"), ([[1.0], 0], "one length"),
                      ([[float("nan")] * 6, 1], "NaN"), ([[0.0] * 6, None], "null"), ([[0.0] * 6, 2], "0 and 1")):
        with pytest.raises(Exception, match=text):
            odd = df.limit(5).unionByName(spark.createDataFrame([bad], df.schema))
            grow.binned(odd, grow.bin_borders(odd))
    rules = {"sqrt": 8, "log2": 6, "onethird": 22, "all": 64, "5": 5, "0.1": 7}
    assert {k: grow.features_of_a_split(k, 64) for k in rules} == rules


@pytest.mark.parametrize("most", [16, 40])
def test_borders_count_every_row(monkeypatch, most):
    monkeypatch.setattr(grow, "POINTS", most)
    import pyarrow as pa
    values = np.random.default_rng(0).permutation(np.r_[np.zeros(3000), np.arange(1, 1001)])
    batches = [pa.RecordBatch.from_pydict({"x": [[float(v)] for v in part], "y": [0] * len(part)})
               for part in np.split(values, 4)]
    points = [(np.array(b["value"][0].as_py()), np.array(b["n"][0].as_py())) for b in grow._points(batches)]
    assert sum(n.sum() for _, n in points) == 4000 and max(len(v) for v, _ in points) <= most
    borders = grow._borders(*(np.concatenate(c) for c in zip(*points)))
    assert len(borders) <= 31 and borders == sorted(set(borders)) and 0 < borders[0]


def test_a_graph_alone_and_among_others_has_the_same_probability():
    import pyarrow as pa
    from flowverdict.operators import graph_batch as gb
    kind = pa.list_(pa.struct([("fromId", pa.string()), ("toId", pa.string())]))
    graph = [{"fromId": "/a", "toId": "/b"}]
    alone, many = (gb.make_batch(pa.array([graph] * n, kind)) for n in (1, 300))
    for seed in range(300):
        weights = gb.initial_weights()
        flat = weights.flat()
        weights = weights.like(flat + np.random.default_rng(seed).normal(scale=0.1, size=flat.shape))
        p = gb.forward(alone, weights, even=True)[0][0]
        assert (gb.forward(many, weights, even=True)[0] == p).all()
        assert p == pytest.approx(gb.forward(alone, weights)[0][0], abs=1e-12)


def test_file_task_report_and_store(spark, folder, models, tmp_path):
    from catalog.learning import graph_rows
    from catalog.traffic import features
    from flowverdict.schemas import c
    many = c("sequence_length(count)") > 15
    rows = features(spark, folder).withColumns({
        "copies": F.lit(1), "source": F.when(~many, F.col("source"))})
    scored, skipped = detect.detect_batch(rows, graph_rows(spark, folder), models, 7)
    task = spark.createDataFrame([(7, "t", "2024-01-01 00:00:00", "2024-01-01 00:00:02.5")],
                                 "task_id long, name string, a string, b string")
    task = task.select("task_id", F.to_timestamp("a").alias("start_time"),
                       F.to_timestamp("b").alias("end_time"))
    summary, report = detect.task_report(scored, skipped, task)
    got = summary.first()
    assert got["record_count"] == scored.count() and got["skipped_count"] == skipped.count() > 0
    assert got["duration"] == 2500 and got["status"] == "COMPLETED"
    assert got["anomaly_rate"] == pytest.approx(got["anomaly_count"] / got["record_count"])
    assert report.count() == min(100, skipped.count())
    tasks = spark.createDataFrame([(7, "Nightly")], "id long, task_name string")
    detect.store_task(scored, tasks, 7, 1000, str(tmp_path / "r"))
    stored = VerdictStore(spark, str(tmp_path / "r")).read()
    assert stored.count() == scored.count() == stored.select("id").distinct().count()
    assert stored.select("detect_type", "file_id", "task_name").distinct().collect() == [
        (1, 7, "Nightly")]
    times = sorted(r["timestamp"] for r in stored.collect())
    assert times == list(range(1000, 1000 + len(times)))
    assert not detect.store_task(scored, tasks, 7, 9000, str(tmp_path / "r"))  # run again
    detect.store_task(scored, tasks, 8, 1000, str(tmp_path / "r"))  # unknown task: no rows
    assert VerdictStore(spark, str(tmp_path / "r")).read().count() == len(times)


def literal_models():
    from catalog.learning import _LITERAL
    return _LITERAL


@pytest.mark.parametrize("task_edges", [200_000, 0])
def test_mixed_records_decide_for_themselves(spark, monkeypatch, task_edges):
    from flowverdict.operators import gcn
    monkeypatch.setattr(gcn.score_edges, "__defaults__", (task_edges,))
    graph = [("/a", "/b"), ("/b", "/c"), ("/a", "/b")]
    full = [3.0] * 7 + ["default", "E"]
    rows = [("both", *full, graph), ("rf", *full, None), ("gcn", *[None] * 9, graph), ("none", *[None] * 9, []),
            ("bad", *[3.0] * 7, "default", None, graph), ("some", 1.0, *[None] * 8, graph)]
    names = ", ".join(f"`{n}` {'double' if k < 7 else 'string'}" for k, n in enumerate(MODEL_INPUT))
    df = spark.createDataFrame(
        rows, f"trace_id string, {names}, call_graph array<struct<fromId:string,toId:string>>")
    scored, skipped = detect.detect_records(df, literal_models())
    got = {r["trace_id"]: r for r in scored.collect()}
    assert {k: r["mode"] in ("rf_only", "gcn_only") and r["mode"] for k, r in got.items()} == {
        "both": False, "rf": "rf_only", "gcn": "gcn_only", "none": False}
    assert {r["id"] for r in skipped.collect()} == {"bad", "some"}
    assert got["rf"]["final_prob"] == 3.0 / 24 and got["none"]["final_prob"] == 0.0
    assert got["gcn"]["features_json"] is None and got["rf"]["call_graph_json"] is None
    edges = df.select("trace_id", F.posexplode("call_graph").alias("pos", "e")).select(
        "trace_id", "pos", F.col("e.fromId").alias("from_id"), F.col("e.toId").alias("to_id"))
    joined, missed = detect.detect_records(df.drop("call_graph"), literal_models(), edges)
    assert missed.count() == 2
    for r in joined.collect():
        for name in ("rf_prob", "gcn_prob", "final_prob", "is_anomaly", "mode", "threshold"):
            assert r[name] == pytest.approx(got[r["trace_id"]][name])
    assert detect.detect_records(df.select("trace_id", "call_graph").limit(0), literal_models())[0].count() == 0


def test_capture_task_reports_graphs_and_broken_files(spark, tmp_path):
    from tests.test_sources import capture, frame
    from flowverdict.sources import captures
    get = b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n"
    for name, n in (("a", 3), ("b", 9), ("c", 1)):
        (tmp_path / f"{name}.pcap").write_bytes(capture(
            [(10.0 + i, frame("10.0.0.1", "10.0.0.2", 5, 80, get % (i % 3))) for i in range(n)]))
    (tmp_path / "x.pcap").write_bytes(b"no capture")
    task = spark.createDataFrame([(4,)], "task_id long")
    scored, summary, broken = detect.detect_capture_task(
        captures.read_packets(spark, str(tmp_path)), literal_models(), task)
    rows = sorted((r["call_graph_json"] or "[]").count("fromId") for r in scored.collect())
    assert rows == [0, 2, 8]
    got = summary.first()
    assert (got["record_count"], got["skipped_count"], got["status"]) == (3, 1, "COMPLETED")
    assert [tuple(r) for r in broken.collect()] == [("x.pcap", "not a capture file")]
    packets = captures.good_packets(captures.read_packets(spark, str(tmp_path)))
    short = detect.detect_captures(packets, literal_models(), 4, text_edges=2)
    assert sorted((r["call_graph_json"] or "[]").count("fromId") for r in short.collect()) == [0, 0, 2]


def test_captures_from_files_to_verdicts(spark, models, tmp_path):
    from tests.test_sources import capture, frame
    from flowverdict.sources import captures
    get = b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n"
    (tmp_path / "a.pcap").write_bytes(capture(
        [(10.0 + i, frame("10.0.0.1", "10.0.0.2", 5, 80, get % (i % 3))) for i in range(9)]))
    (tmp_path / "8.8.8.8_1_2.2.2.2_8.pcap").write_bytes(capture(
        [(1.0, frame("8.8.8.8", "2.2.2.2", 1, 8, b"no request"))]))
    decoded = captures.decode_packets(captures.scan_captures(spark, str(tmp_path)))
    out = detect.detect_captures(captures.good_packets(decoded), models, 3).collect()
    by_ip = {r["source_ip"]: r for r in out}
    assert by_ip["10.0.0.1"]["trace_id"].startswith("pcap-3-")
    assert by_ip["10.0.0.1"]["gcn_prob"] > 0 and by_ip["10.0.0.1"]["mode"] != "rf_only"
    assert by_ip["8.8.8.8"]["mode"] == "rf_only" and by_ip["8.8.8.8"]["gcn_prob"] == 0.0
