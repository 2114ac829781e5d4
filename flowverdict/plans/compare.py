"""All fusion methods side by side on the same split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fusion as fu
from ..operators import gate as gt, grids
from ..operators.forest import ForestScorer, train_forest
from ..operators.gcn import Net, fit_gcns, score_nets
from ..operators.graph_batch import Weights
from ..operators.lineage import checkpointed
from ..operators.metrics import (
    best_per_category, classification_metrics, pick_best, run_stability, score_distribution,
    split_overlap,
)

CATEGORIES = {
    "rf": "single", "gcn1": "single", "gcn2": "single", "gcn3": "single", "fixed": "fixed",
    "strategy1": "strategy", "strategy2": "strategy", "dual": "dual", "gate": "learned",
}


def _parameters(search: DataFrame, names, rule) -> dict:
    row = pick_best(search, rule).first()
    return {n: row[n] for n in names} if row is not None else {n: 0.0 for n in names}


def fit_methods(val: DataFrame, spaces=None, epochs: int = gt.EPOCHS, gate=None) -> dict:
    """Parameters of every fusion method, chosen on ``val`` (rf_prob, gcn_prob, y); a ``gate`` that
    is given is not fitted."""
    spaces = {"strategy1": grids.STRATEGY1, "strategy2": grids.STRATEGY2, "dual": grids.DUAL} | (
        spaces or {})
    alphas = grids.search_fixed(val.withColumn("gcn_layers", F.lit(2)))
    fixed = pick_best(alphas, tie="alpha").first()
    return {
        "fixed": {"alpha": fixed["alpha"] if fixed else fu.EXPERIMENT_FIXED_ALPHA},
        "strategy1": _parameters(grids.search_strategy1(val, spaces["strategy1"]),
                                 spaces["strategy1"], "max_f1"),
        "strategy2": {"alpha": fu.EXPERIMENT_FIXED_ALPHA} | _parameters(
            grids.search_strategy2(val, spaces["strategy2"]), spaces["strategy2"], "min_fnr"),
        "dual": _parameters(grids.search_dual(val, spaces["dual"]), spaces["dual"], "min_fnr"),
        "gate": gt.fit_gate(val, epochs=epochs) if gate is None else gate,
    }


def compare_scores(rows: DataFrame, methods: dict, gcn: str = "gcn_prob") -> DataFrame:
    """One metric row per method. ``rows``: rf_prob, y, ``gcn`` and any gcn1, gcn2, gcn3.

    All verdicts of a row are columns of one pass, turned into rows just before the sums.
    """
    rf, g = F.col("rf_prob"), F.col(gcn)
    judged = gt.score_gate(rows, methods["gate"], gcn=gcn)
    verdicts = {"rf": fu.hard(rf)}
    verdicts |= {n: fu.hard(F.col(n)) for n in ("gcn1", "gcn2", "gcn3") if n in rows.columns}
    verdicts |= {
        "fixed": fu.fuse_fixed(rf, g, **methods["fixed"])["verdict"],
        "strategy1": fu.fuse_confidence_weight(rf, g, **methods["strategy1"])["verdict"],
        "strategy2": fu.fuse_adaptive_threshold(rf, g, **methods["strategy2"])["verdict"],
        "dual": fu.fuse_dual(rf, g, **methods["dual"])["verdict"],
        "gate": F.col("gate_verdict"),
    }
    entries = F.array(*[
        F.struct(F.lit(n).alias("method"), F.lit(CATEGORIES[n]).alias("category"),
                 v.alias("predicted"))
        for n, v in verdicts.items()
    ])
    return classification_metrics(judged.select("y", F.inline(entries)), ["method", "category"])


def score_split(rows: DataFrame, forest: ForestScorer, nets: list[Weights]) -> DataFrame:
    """Labelled rows with features and ``call_graph``: their forest probability and, in
    ``gcn_probs``, those of all nets. A row meets the forest once and is laid out once."""
    return score_nets(forest(rows.where(F.size("call_graph") > 0)), nets)


def judge_methods(
    val: DataFrame, test: DataFrame, forest: ForestScorer, nets: dict[int, Weights],
    spaces=None, gate_epochs: int = gt.EPOCHS,
) -> DataFrame:
    """Choose the parameters of every method on ``val`` and judge them on ``test``."""
    return judge_runs(val, test, forest, [nets], spaces, gate_epochs)[0]


def judge_runs(
    val: DataFrame, test: DataFrame, forest: ForestScorer, runs: list[dict[int, Weights]],
    spaces=None, gate_epochs: int = gt.EPOCHS,
) -> list[DataFrame]:
    """``judge_methods`` for the nets of several runs, all of the same depths.

    The splits are scored once by the forest and all nets, and the gates of all runs are fitted
    in the same jobs.
    """
    depths = list(runs[0])
    main = 2 if 2 in depths else max(depths)
    names = [f"gcn{d}_{k}" for k in range(len(runs)) for d in depths]
    scored = [
        checkpointed(score_split(x, forest, [nets[d] for nets in runs for d in depths]).select(
            "rf_prob", "y", *[F.get("gcn_probs", F.lit(i)).alias(n) for i, n in enumerate(names)]))
        for x in (val, test)
    ]
    gates = gt.fit_gates(scored[0], [gt.SEED] * len(runs), epochs=gate_epochs,
                         gcn=[f"gcn{main}_{k}" for k in range(len(runs))])
    out = []
    for k, gate in enumerate(gates):
        mine = [x.select("rf_prob", *[F.col(f"gcn{d}_{k}").alias(f"gcn{d}") for d in depths],
                         F.col(f"gcn{main}_{k}").alias("gcn_prob"), "y") for x in scored]
        out.append(compare_scores(mine[1], fit_methods(mine[0], spaces, gate=gate)))
    return out


def compare_methods(
    train: DataFrame, val: DataFrame, test: DataFrame, depths=(1, 2, 3), epochs: int = 10,
    hidden: int = 64, spaces=None, gate_epochs: int = gt.EPOCHS, **forest,
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train``, choose on ``val``, judge on ``test``: (metrics, best per category).

    All tables: _id, feature columns, classification, y, call_graph. Rows of a split keep
    the scaler of the model that scores them.
    """
    scorer = train_forest(train.drop("call_graph", "y"), **forest)
    nets = dict(zip(depths, fit_gcns(train, [Net(hidden, d) for d in depths], epochs)))
    metrics = judge_methods(val, test, scorer, nets, spaces, gate_epochs)
    return metrics, best_per_category(metrics, "rf")


def gate_stability(
    train: DataFrame, val: DataFrame, test: DataFrame, runs: int = 5, epochs: int = 75,
    seed: int = 42, key: str = "trace_id",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Is the learned gate stable? (metrics of every run on ``test``, their spread, probability
    distributions per split, ids that splits share).

    Gates of ``runs`` seeds are fitted on ``train`` in the same jobs; of each, the weights of the
    epoch with the least loss on ``val`` are judged. All tables: ``key``, rf_prob, gcn_prob, y.
    """
    seeds = [seed + 1000 * k for k in range(runs)]
    gates = gt.fit_gates(train, seeds, epochs=epochs, validation=val, patience=epochs)
    rows = test.select("rf_prob", "gcn_prob", "y")
    for k, gate in enumerate(gates, 1):
        rows = gt.score_gate(rows, gate).withColumnRenamed("gate_verdict", f"run{k}").drop("alpha", "gate_prob")
    verdicts = F.array(*[F.struct(F.lit(k).alias("run"), F.col(f"run{k}").alias("predicted"))
                         for k in range(1, runs + 1)])
    metrics = classification_metrics(rows.select("y", F.inline(verdicts)), ["run"])
    parts = reduce(DataFrame.unionByName, [
        df.select("rf_prob", "gcn_prob").withColumn("split", F.lit(name))
        for name, df in (("train", train), ("val", val), ("test", test))])
    return (metrics, run_stability(metrics, [], "run"),
            score_distribution(parts, ["split"], ["rf_prob", "gcn_prob"]),
            split_overlap(train, val, test, key))


def sweep_epochs(
    train: DataFrame, val: DataFrame, test: DataFrame, epochs: list[int], depths=(1, 2, 3),
    hidden: int = 64, spaces=None, gate_epochs: int = gt.EPOCHS, **forest,
) -> DataFrame:
    """``compare_methods`` after several epoch counts: one forest, one run of all nets, one pass
    over the splits."""
    scorer = train_forest(train.drop("call_graph", "y"), **forest)
    runs = fit_gcns(
        train, [Net(hidden, d) for d in depths], max(epochs), snapshots=list(epochs))
    judged = judge_runs(val, test, scorer, [dict(zip(depths, runs[n])) for n in epochs], spaces,
                        gate_epochs)
    return reduce(DataFrame.unionByName, [
        metrics.withColumn("epochs", F.lit(n)) for n, metrics in zip(epochs, judged)])
