"""Lookups between features, graphs, scores and requests, as equi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schemas import CALL_GRAPH, TRAINING_ONLY, c


def _empty_graph():
    return F.array().cast(CALL_GRAPH)


def pair_features_graphs(
    features: DataFrame | None, graphs: DataFrame | None, copies: str = "copies"
) -> DataFrame:
    """Records of a file task, with ``call_graph``.

    ``features`` has one row per ``_id`` (the first of the file) and the number of
    ``copies`` the file holds; ``graphs`` one row per ``_id``. With both, the common ids
    are taken; if there are none, every feature row is taken, copies included. With one
    of them, its ids are taken. The choice is made by scalar subqueries inside the plan.
    """
    if features is None:
        return graphs.select("_id", F.coalesce("call_graph", _empty_graph()).alias("call_graph"))
    if graphs is None:
        return features.drop(copies).withColumn("call_graph", _empty_graph())
    known = graphs.select("_id", "call_graph", F.lit(True).alias("_known"))
    common = (
        features.select("_id").join(graphs.select("_id"), "_id", "left_semi")
        .limit(1).agg(F.count(F.lit(1)))
    ).scalar()
    given = graphs.select("_id").limit(1).agg(F.count(F.lit(1))).scalar()
    joined = features.join(known, "_id", "left")
    wanted = joined.where((common == 0) | F.col("_known"))
    all_copies = (common == 0) & (given == 1)
    repeat = F.when(all_copies, F.col(copies)).otherwise(F.lit(1)).cast("int")
    names = [n for n in features.columns if n != copies]
    return wanted.select(
        *[c(n) for n in names],
        F.coalesce("call_graph", _empty_graph()).alias("call_graph"),
        F.explode(F.sequence(F.lit(1), repeat)).alias("_copy"),
    ).drop("_copy")


def align_scores(rf: DataFrame, gcn: DataFrame) -> DataFrame:
    """Both probabilities of the rows that have a graph score."""
    return rf.join(gcn, "trace_id")


def pair_by_id(records: DataFrame, graphs: DataFrame) -> DataFrame:
    """Capture records with the graph of the same id, or an empty one."""
    return records.join(graphs, "_id", "left").withColumn(
        "call_graph", F.coalesce("call_graph", _empty_graph())
    )


def to_request_messages(features: DataFrame, graphs: DataFrame, source_ip, timestamp) -> DataFrame:
    """Detection messages ``(trace_id, value)``: features without id, label and behaviour
    columns, and the graph, as one JSON text."""
    names = [n for n in features.columns if n not in ["_id", "source_ip", *TRAINING_ONLY]]
    joined = pair_by_id(features, graphs)
    message = F.struct(
        F.col("_id").alias("traceId"),
        source_ip.alias("sourceIp"),
        timestamp.alias("timestamp"),
        F.struct(*[c(n) for n in names]).alias("features"),
        F.col("call_graph").alias("callGraph"),
    )
    return joined.select(F.col("_id").alias("trace_id"), F.to_json(message).alias("value"))


def explain_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Stored features and graph of each requested trace; unknown traces drop out."""
    return requests.select("trace_id").distinct().join(
        results.select("trace_id", "features_json", "call_graph_json"), "trace_id"
    )


def missing_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    return requests.select("trace_id").distinct().join(results, "trace_id", "left_anti")


def common_ids(a: DataFrame, b: DataFrame, key: str = "_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def concat_results(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
