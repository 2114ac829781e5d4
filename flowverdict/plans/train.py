"""The training job: all models of the detection jobs, with a report on the rows they saw."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fusion import hard
from ..functions.records import label
from ..operators.forest import feature_importances, train_forest
from ..operators.gcn import Net, fit_gcns, score_nets
from ..operators.lineage import checkpointed
from ..operators.metrics import classification_metrics
from .detect import Models


def train_models(
    features: DataFrame, graphs: DataFrame, hidden: int = Net.hidden, epochs: int | None = None, **forest,
) -> tuple[Models, DataFrame, DataFrame]:
    """(models, report, ranked feature importances).

    ``features``: _id, feature columns and ``classification``; ``graphs``: _id and ``call_graph``.
    The forest learns from all rows, balanced; both nets learn, in the same jobs, from the graphs
    that have edges and a labelled row, positives weighted by their share. The report has the
    metrics of each model (``rf``, ``gcn``, ``fallback``) on what it learnt from. ``save_models``
    stores the models.
    """
    rows = checkpointed(features.withColumn("y", label(F.col("classification"))))
    labelled = checkpointed(graphs.join(rows.select("_id", "y"), "_id").where(F.size("call_graph") > 0))
    scorer = train_forest(rows.drop("y"), **forest)
    setting = {} if epochs is None else {"epochs": epochs}
    nets = fit_gcns(labelled, [Net(hidden, 2), Net(hidden, 1)], pos_weight="balanced", **setting)
    seen = scorer(rows).select(F.lit("rf").alias("model"), "y", F.col("rf_prob").alias("p"))
    names = F.array(F.lit("gcn"), F.lit("fallback"))
    judged = score_nets(labelled.select("call_graph", "y"), nets).select(
        "y", F.posexplode("gcn_probs").alias("k", "p")).select(F.get(names, F.col("k")).alias("model"), "y", "p")
    report = classification_metrics(
        seen.unionByName(judged).select("model", "y", hard(F.col("p")).alias("predicted")), ["model"])
    return Models(scorer, *nets), report, feature_importances(scorer, features.sparkSession)
