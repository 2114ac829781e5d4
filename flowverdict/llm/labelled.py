"""A bounded sample of labelled texts, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import learnt_from


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
           rows: int, most_bytes: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """``[(label, text)]`` and the number of usable labels of each class.

    Only ids whose crc32 modulo ``modulus`` is not ``held_out`` are learnt from. Of each class
    the first ``rows`` ids by their hash are taken, whole texts, until ``most_bytes`` a class
    are reached. NULL ids, labels and texts are not learnt from; of an id labelled twice the
    larger label counts.
    """
    usable = labels.where(learnt_from(F.col("doc_id"), modulus, held_out)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    ).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    first = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(order, "doc_id")
             .limit(rows).select("doc_id", "y", order.alias("h")).collect()]
    if not first:
        return [], counts
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    ids = spark.createDataFrame(first, "doc_id long, y int, h long")  # at most 2 x ``rows``
    sizes = source.join(F.broadcast(ids), "doc_id").select(
        "doc_id", "y", "h", F.octet_length("text").alias("size")).distinct().collect()
    held, chosen = {0: 0, 1: 0}, set()
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"], r["size"])):
        if held[r["y"]] + r["size"] <= most_bytes:
            held[r["y"]] += r["size"]
            chosen.add((r["doc_id"], r["size"]))
    picked = spark.createDataFrame(
        [(r["doc_id"], r["y"], r["h"]) for r in sizes if (r["doc_id"], r["size"]) in chosen],
        "doc_id long, y int, h long").distinct() if chosen else None
    if picked is None:
        return [], counts
    found = source.join(F.broadcast(picked), "doc_id").select("h", "doc_id", "y", "text").distinct().collect()
    out = [(r["y"], r["text"]) for r in sorted(found, key=lambda r: (r["h"], r["doc_id"], r["text"]))
           if (r["doc_id"], len(r["text"].encode())) in chosen]
    return out, counts


def fit_logistic(x, y, weight, steps: int = 60):
    """Slopes and intercept of P(1 | x) for rows of features, by damped Newton steps."""
    import numpy as np

    x, y, weight = np.asarray(x, float).reshape(len(y), -1), np.asarray(y, float), np.asarray(weight, float)
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    beta, ridge = np.zeros(z.shape[1]), 1e-3 * np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge @ beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max() / 2)
    return beta[:-1] / scale, float(beta[-1])


def class_weights(labels: list[int], counts: dict[int, int]):
    """Weights that give each class of the sample its share of ``counts``; 1 on average."""
    import numpy as np

    labels = np.asarray(labels)
    share = {y: counts.get(y, 1) / max(1, int((labels == y).sum())) for y in (0, 1)}
    weight = np.where(labels == 1, share[1], share[0])
    return weight / weight.mean()
