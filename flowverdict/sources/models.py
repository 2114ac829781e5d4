"""Fitted models on shared storage: the forest in its own format, the rest as tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession, functions as F

from ..operators.forest import ForestScorer
from ..operators.graph_batch import Weights
from ..operators.prepare import Preparation, Scaler, code_maps
from ..plans.detect import Models


def save_models(models: Models, spark: SparkSession, folder: str) -> None:
    p = models.forest.preparation
    models.forest.model.write().overwrite().save(f"{folder}/forest")
    columns = [
        (i, n, n in p.categorical, float(m), float(s))
        for i, (n, m, s) in enumerate(zip(p.columns, p.scaler.mean, p.scaler.scale))
    ]
    spark.createDataFrame(
        columns, "position int, column string, categorical boolean, mean double, scale double"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")
    if isinstance(p.codes, dict):
        codes = spark.createDataFrame([(n, v, int(k)) for n, m in p.codes.items() for v, k in m.items()],
                                      "column string, value string, code bigint").coalesce(1)
    else:
        codes = p.codes.select("column", "value", F.col("code").cast("long").alias("code"))
    codes.write.mode("overwrite").parquet(f"{folder}/codes")
    layers = []
    for name, w in (("gcn", models.gcn), ("fallback", models.fallback)):
        for i, (matrix, bias) in enumerate([*w.layers, (w.head[0][:, None], [w.head[1]])]):
            layers.append((name, i, np.asarray(matrix).tolist(), [float(b) for b in bias]))
    spark.createDataFrame(
        layers, "net string, layer int, w array<array<double>>, b array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/nets")


def load_models(spark: SparkSession, folder: str) -> Models:
    rows = spark.read.parquet(f"{folder}/columns").orderBy("position").collect()
    table = spark.read.parquet(f"{folder}/codes")
    codes = code_maps(table)
    codes = table if codes is None else codes
    names = [r["column"] for r in rows]
    preparation = Preparation(
        codes, Scaler(names, [r["mean"] for r in rows], [r["scale"] for r in rows]), names,
        [r["column"] for r in rows if r["categorical"]],
    )
    nets: dict = {}
    for r in spark.read.parquet(f"{folder}/nets").orderBy("net", "layer").collect():
        nets.setdefault(r["net"], []).append((np.array(r["w"]), np.array(r["b"])))
    weights = {
        n: Weights(layers[:-1], (layers[-1][0][:, 0], float(layers[-1][1][0])))
        for n, layers in nets.items()
    }
    forest = RandomForestClassificationModel.load(f"{folder}/forest")
    return Models(ForestScorer(preparation, forest), weights["gcn"], weights["fallback"])
