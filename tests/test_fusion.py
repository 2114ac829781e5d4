import itertools

import pytest
from pyspark.sql import functions as F

from flowverdict.functions import fusion as fu
from flowverdict.operators import grids

HAND = [  # rf, gcn, mode, fused, threshold, verdict
    (0.90, 0.80, "consistent", 0.84, 0.50, 1),
    (0.90, 0.30, "rf_high_conf", 0.54, 0.52, 1),
    (0.60, 0.40, "rf_low_conf", 0.43, 0.58, 0),
    (0.20, 0.90, "gcn_high_conf", 0.48, 0.46, 1),
    (0.40, 0.60, "gcn_low_conf", 0.52, 0.49, 1),
    (0.50, 0.50, "consistent", 0.50, 0.50, 0),
]


def test_adaptive_by_hand(spark):
    df = spark.createDataFrame([h[:2] for h in HAND], "rf_prob double, gcn_prob double")
    for got, (rf, gcn, mode, prob, threshold, verdict) in zip(fu.fuse(df).collect(), HAND):
        f = got["fusion"]
        assert f["mode"] == mode and f["verdict"] == verdict
        assert f["prob"] == pytest.approx(prob) and f["threshold"] == pytest.approx(threshold)


def test_fallback_modes(spark):
    rows = [(0.9, 0.1, True, False), (0.1, 0.9, False, True), (0.0, 0.0, False, False),
            (0.9, 0.8, True, True), (0.5, 0.9, True, False)]
    df = spark.createDataFrame(
        rows, "rf_prob double, gcn_prob double, has_features boolean, has_graph boolean")
    got = [(r["mode"], r["is_anomaly"]) for r in fu.fuse_with_fallback(df).collect()]
    assert got == [("rf_only", 1), ("gcn_only", 1), ("consistent", 0), ("consistent", 1),
                   ("rf_only", 0)]
    fixed = fu.fuse_with_fallback(df, "fixed").collect()
    assert fixed[3]["mode"] == "fixed" and fixed[3]["final_prob"] == pytest.approx(
        0.33 * 0.9 + 0.67 * 0.8)


def test_method_may_be_a_function(spark):
    df = spark.createDataFrame([(0.2, 0.4)], "rf_prob double, gcn_prob double")
    out = fu.fuse(df, lambda rf, gcn: (rf + gcn) / 2).first()
    assert out["fusion"] == pytest.approx(0.3)


def _weight(rf, gcn, alpha, limit, high, low):
    sure_rf, sure_gcn = abs(rf - 0.5) * 2, abs(gcn - 0.5) * 2
    if (rf > 0.5) == (gcn > 0.5):
        return alpha
    if sure_rf > limit and sure_gcn > limit:
        return high if sure_rf > sure_gcn else low
    return high if sure_rf > limit else low if sure_gcn > limit else alpha


def _threshold(rf, gcn, up, down):
    t = 0.5
    if rf > 0.5 >= gcn:
        t += up
    elif gcn > 0.5 >= rf:
        t -= down
    return max(0.1, min(0.9, t))


ROWS = [(i / 10, j / 10, (i * j + i) % 2) for i in range(11) for j in range(11)]


@pytest.mark.parametrize("turned", [False, True])
def test_searches_by_brute_force(spark, turned):
    """Ties included: tenths meet thresholds exactly. The values may come in any order."""
    df = spark.createDataFrame(ROWS, "rf_prob double, gcn_prob double, y int")
    space = {k: v[:3][::-1] if turned else v[:3] for k, v in grids.DUAL.items()}
    got = {r["cell"]: r for r in grids.search_dual(df, space).collect()}
    cells = list(itertools.product(*space.values()))
    assert len(got) == len(cells)
    for cell, (alpha, limit, high, low, up, down) in enumerate(cells):
        tp = fp = 0
        for rf, gcn, y in ROWS:
            w = _weight(rf, gcn, alpha, limit, high, low)
            hit = w * rf + (1 - w) * gcn > _threshold(rf, gcn, up, down)
            tp += hit and y == 1
            fp += hit and y == 0
        assert (got[cell]["tp"], got[cell]["fp"]) == (tp, fp), cell


def test_search_fixed_by_brute_force(spark):
    df = spark.createDataFrame([(1, *r) for r in ROWS],
                               "gcn_layers int, rf_prob double, gcn_prob double, y int")
    got = {r["alpha"]: r for r in grids.search_fixed(df).collect()}
    assert len(got) == 101
    for i in range(101):
        a = i / 100
        tp = sum(a * rf + (1 - a) * gcn > 0.5 and y == 1 for rf, gcn, y in ROWS)
        assert got[a]["tp"] == tp


def test_full_dual_grid_size(spark):
    assert grids.parameter_grid(spark, grids.DUAL).count() == 57_600
    first = grids.parameter_grid(spark, grids.DUAL).where("cell = 49").first()
    assert first["weight_low_conf"] == 0.15 and first["threshold_adjust_gcn"] == 0.05


def test_grid_columns_as_parameters(spark):
    df = spark.createDataFrame([(0.9, 0.3, 0.5)], "rf_prob double, gcn_prob double, a double")
    out = df.select(fu.fuse_fixed(F.col("rf_prob"), F.col("gcn_prob"), F.col("a"))["prob"])
    assert out.first()[0] == pytest.approx(0.6)
