"""Learned fusion gate: a small net gives the forest's weight for each row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.fusion import confidence, weighted
from ..schemas import c
from .gcn import Adam, summed
from .lineage import checkpointed

# Layer widths of the plain nets and the training settings.
NETS = {"small": [4, 16, 8, 1], "extended": [6, 16, 8, 1], "deep": [6, 32, 64, 32, 16, 1]}
EPOCHS, RATE, PATIENCE, SEED = 100, 0.01, 10, 42


def initial_gate(widths: list[int], seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for rows, cols in zip(widths[:-1], widths[1:]):
        limit = np.sqrt(6.0 / (rows + cols))
        out.append((rng.uniform(-limit, limit, (rows, cols)), np.zeros(cols)))
    return out


def score_gate(df: DataFrame, gate, rf: str = "rf_prob", gcn: str = "gcn_prob") -> DataFrame:
    """Add ``alpha``, the fused ``gate_prob`` and its verdict.

    Every unit is a column of sums on literal weights and every layer a projection, so the
    whole net is generated code.
    """
    width = gate[0][0].shape[0]
    # NULLs become NaN on the way through: columns that cannot be NULL make small code.
    sure = [F.coalesce(F.col(n), F.lit(float("nan"))).alias(f"_p{i}")
            for i, n in enumerate((rf, gcn))]
    names = [c(n) for n in df.columns]
    p0, p1 = F.col("_p0"), F.col("_p1")
    inputs = [p0, p1, confidence(p0), confidence(p1), p0 * p1, F.abs(p0 - p1)][:width]
    out = df.select(*names, *sure).select(
        *names, *sure_names(2), *[v.alias(f"_u{i}") for i, v in enumerate(inputs)])
    for k, (w, b) in enumerate(gate, 1):
        sums = [
            F.expr(f"{float(b[o])!r}D" + "".join(
                f" + {float(v)!r}D * _u{i}" for i, v in enumerate(w[:, o]))).alias(f"_u{o}")
            for o in range(w.shape[1])
        ]
        out = out.select(*names, *sure_names(2), *sums)
        if k < len(gate):
            out = out.select(*names, *sure_names(2), *[
                F.expr(f"if(_u{o} > 0D, _u{o}, 0D)").alias(f"_u{o}") for o in range(w.shape[1])])
    alpha = 1.0 / (1.0 + F.exp(-F.col("_u0")))
    out = out.select(*names, *sure_names(2), alpha.alias("alpha"))
    out = out.withColumn("gate_prob", weighted(p0, p1, F.col("alpha")))
    return out.select(
        *names,
        *[F.when(~F.isnan("gate_prob"), F.col(n)).alias(n) for n in ("alpha", "gate_prob")],
        F.when(~F.isnan("gate_prob"), (F.col("gate_prob") > 0.5).cast("int"))
        .alias("gate_verdict"),
    )


def sure_names(n: int) -> list[str]:
    return [f"_p{i}" for i in range(n)]


def _inputs(rf, gcn, width):
    parts = [rf, gcn, np.abs(rf - 0.5) * 2, np.abs(gcn - 0.5) * 2, rf * gcn, np.abs(rf - gcn)]
    return np.stack(parts[:width], axis=1)


def _fused(rf, gcn, y, gate):
    """Values and sums of the layers, the gate's weight, the fused probability and the loss sum."""
    values = [_inputs(rf, gcn, gate[0][0].shape[0])]
    sums = []
    for i, (w, b) in enumerate(gate):
        z = values[-1] @ w + b
        sums.append(z)
        values.append(np.maximum(z, 0.0) if i < len(gate) - 1 else 1.0 / (1.0 + np.exp(-z)))
    alpha = values[-1][:, 0]
    fused = np.clip(alpha * rf + (1 - alpha) * gcn, 1e-12, 1 - 1e-12)
    loss = -(y * np.log(fused) + (1 - y) * np.log(1 - fused)).sum()
    return values, sums, alpha, fused, float(loss)


def gate_loss(rf, gcn, y, gate):
    """Loss sum and rows, without a way back through the net."""
    return _fused(rf, gcn, y, gate)[-1], len(y)


def gate_gradients(rf, gcn, y, gate):
    """Gradient sum of cross entropy on the fused probability, loss sum and rows."""
    values, sums, alpha, fused, loss = _fused(rf, gcn, y, gate)
    d_fused = (fused - y) / (fused * (1 - fused))
    d = (d_fused * (rf - gcn) * alpha * (1 - alpha))[:, None]
    grads = []
    for i in range(len(gate) - 1, -1, -1):
        grads.append((values[i].T @ d, d.sum(0)))
        if i:
            d = (d @ gate[i][0].T) * (sums[i - 1] > 0)
    return _flat(grads[::-1]), loss, len(y)


def _flat(gate):
    return np.concatenate([p.ravel() for layer in gate for p in layer])


def _like(gate, flat):
    at, out = 0, []
    for w, b in gate:
        out.append((flat[at : at + w.size].reshape(w.shape),
                    flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def fit_gates(
    df: DataFrame, seeds: list[int], widths=None, epochs: int = EPOCHS, rate: float = RATE,
    validation: DataFrame | None = None, patience: int | None = None,
    gcn: list[str] | None = None,
) -> list:
    """Full-batch Adam for a gate of each seed; one Spark job per epoch, whatever the number of
    gates, returns gradient sums on ``df`` and loss sums on ``validation``. A gate that has
    stopped costs nothing any more.

    With ``patience`` the training of a gate stops when its loss (of ``validation`` if given) has
    not improved for so many epochs, and its best weights are returned. ``gcn`` names the graph
    probability of each gate, if that is not the same column.
    """
    gcn = gcn or ["gcn_prob"] * len(seeds)
    names = list(dict.fromkeys(gcn))
    places = [names.index(n) for n in gcn]
    gates = [initial_gate(widths or NETS["small"], seed) for seed in seeds]
    flats = [_flat(gate) for gate in gates]
    columns = [F.col("rf_prob"), F.col("y").cast("double").alias("y"), *map(c, names)]
    rows = df.select(*columns, F.lit(validation is None).alias("judged"), F.lit(True).alias("learnt"))
    if validation is not None:
        rows = rows.unionByName(
            validation.select(*columns, F.lit(True).alias("judged"), F.lit(False).alias("learnt")))
    rows = checkpointed(rows)
    adams = [Adam(rate) for _ in gates]
    best, best_loss, waited = list(flats), [np.inf] * len(gates), [0] * len(gates)
    size = flats[0].size + 4

    def measure(now) -> np.ndarray:
        def call(batch):
            rf, y, *probs, judged, learnt = map(np.asarray, batch.columns)
            out = []
            for gate, place in now:
                prob = probs[place]
                g, loss, n = gate_gradients(rf[learnt], prob[learnt], y[learnt], gate)
                if judged.all() and learnt.all():
                    seen = loss, n
                else:
                    seen = gate_loss(rf[judged], prob[judged], y[judged], gate)
                out.append(np.concatenate([g, [loss, n], seen]))
            return np.concatenate(out)

        return summed(rows, call, size * len(now)).reshape(len(now), size)

    for _ in range(epochs):
        active = [k for k in range(len(gates)) if patience is None or waited[k] < patience]
        if not active:
            break
        out = measure([(_like(gates[k], flats[k]), places[k]) for k in active])
        for k, sums in zip(active, out):
            loss = sums[-2] / max(sums[-1], 1)
            if loss < best_loss[k]:
                best[k], best_loss[k], waited[k] = flats[k], loss, 0
            else:
                waited[k] += 1
            if patience is None or waited[k] < patience:
                flats[k] = adams[k](flats[k], sums[:-4] / max(sums[-3], 1))
    return [_like(gate, b if patience is not None else f) for gate, b, f in zip(gates, best, flats)]


def fit_gate(
    df: DataFrame, widths=None, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED,
    validation: DataFrame | None = None, patience: int | None = None,
):
    """One gate, as ``fit_gates`` fits it."""
    return fit_gates(df, [seed], widths, epochs, rate, validation, patience)[0]
