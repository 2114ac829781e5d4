"""Reasons for single verdicts: feature weights of the forest, edges of the graph net."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.records import features_from_json, graph_from_json
from ..schemas import ABNORMAL_EDGES, WEIGHTS
from .forest import ForestScorer, forest_probability
from .gcn import TASK_EDGES, dot, graph_lengths, literal, row_pieces
from .graph_batch import Weights, edge_importance, make_batch
from .graphs import weighted_pairs
from .joins import explain_requests
from .lineage import checkpointed
from .ordering import PART_ROWS, in_order
from .smote import uniform

SAMPLES, TOP, RIDGE = 1000, 5, 1.0
FIT_ROWS = 1000  # rows fitted in one go


def _normal(*key: Column) -> Column:
    """Standard normal number that depends on ``key`` only (Box-Muller)."""
    u1 = uniform(*key, F.lit(1)) + F.lit(2.0**-53)
    u2 = uniform(*key, F.lit(2))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def background(spark, d: int, samples: int = SAMPLES, seed: int = 42) -> DataFrame:
    """``samples`` points ``x`` around the training mean, in scaled units, where mean and
    deviation are 0 and 1."""
    drawn = F.array(*[_normal(F.col("id"), F.lit(j), F.lit(seed)) for j in range(d)])
    return spark.range(1, samples + 1).select("id", drawn.alias("x"))


def explain_forest(
    rows: DataFrame, scorer: ForestScorer, samples: int = SAMPLES, seed: int = 42, model=None,
) -> DataFrame:
    """Weights of a local linear model per row: (trace_id, feature, weight).

    ``rows``: trace_id and feature columns. Points around the training mean and the row itself
    are weighted by their nearness to the row, and a ridge model is fitted to their scores
    (Ribeiro et al. 2016). The points depend on the mean, not on the row: all rows share
    ``samples`` of them, which are drawn and scored once, so the forest scores rows + samples.
    The driver and the tasks hold these points; a task fits its rows batch by batch as matrix
    products. ``model`` may replace the forest by any function that adds ``rf_prob`` to rows
    with ``x``.
    """
    names = scorer.preparation.columns
    d = len(names)
    score = model or (lambda df: forest_probability(df, scorer.model))
    base = score(scorer.preparation.apply(rows).select("trace_id", "x"))
    drawn = score(background(rows.sparkSession, d, samples, seed)).orderBy("id").collect()
    points = np.array([r["x"] for r in drawn]).reshape(-1, d)
    values = np.array([r["rf_prob"] for r in drawn])

    def solve(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, FIT_ROWS):
                part = batch.slice(low, FIT_ROWS)
                x = np.asarray(part.column("x").flatten()).reshape(part.num_rows, d)
                w = local_weights(x, np.asarray(part.column("rf_prob")), points, values)
                yield pa.RecordBatch.from_pydict({
                    "trace_id": part.column("trace_id").take(
                        pa.array(np.repeat(np.arange(len(x)), d))),
                    "feature": pa.array(names * len(x), pa.string()),
                    "weight": pa.array(w.ravel(), pa.float64()),
                })

    return base.select("trace_id", "x", "rf_prob").mapInArrow(
        solve, "trace_id string, feature string, weight double")


def local_weights(
    x: np.ndarray, p: np.ndarray, points: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """Ridge weights around every row of ``x`` (scored ``p``): normal equations of all rows as
    one matrix product over the shared ``points`` (scored ``values``), solved together."""
    d = x.shape[1]
    far = (x**2).sum(1)[:, None] - 2.0 * x @ points.T + (points**2).sum(1)[None, :]
    near = np.exp(-np.maximum(far, 0.0) / (2 * 0.75 * 0.75 * d))  # root of the kernel
    z = np.hstack([np.ones((len(points), 1)), points])
    own = np.hstack([np.ones((len(x), 1)), x])  # the row itself: distance 0, weight 1
    outer = (z[:, :, None] * z[:, None, :]).reshape(len(points), -1)
    a = (near @ outer).reshape(-1, d + 1, d + 1) + own[:, :, None] * own[:, None, :]
    b = near @ (z * values[:, None]) + own * p[:, None]
    a[:, np.arange(1, d + 1), np.arange(1, d + 1)] += RIDGE
    return np.linalg.solve(a, b[:, :, None])[:, 1:, 0] if len(x) else np.zeros((0, d))


def top_weights(weights: DataFrame, n: int = TOP) -> DataFrame:
    """The n features of largest absolute weight per trace. A trace has as many rows as the
    model has features, so the window groups are small."""
    w = Window.partitionBy("trace_id").orderBy(F.desc(F.abs("weight")), "feature")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def explain_graph(
    rows: DataFrame, weights: Weights, fallback: Weights | None = None
) -> DataFrame:
    """Importance of every edge: (trace_id, pos, from_id, to_id, importance).

    ``rows``: trace_id, call_graph and, with ``fallback``, has_features. The importance of
    an edge is how much the probability falls without its message.
    """
    def explain(batches):
        for whole in batches:
            for batch in row_pieces(whole):
                graphs = batch.column("call_graph")
                g = make_batch(graphs)
                value = edge_importance(g, weights)
                if fallback is not None:
                    rich = np.asarray(batch.column("has_features").fill_null(False))
                    value = np.where(rich[g.edge_graph], value, edge_importance(g, fallback))
                # Back to the edges as listed: copies share the value of their pair.
                lengths = graph_lengths(graphs)
                of = np.repeat(np.arange(len(lengths)), lengths)
                edges = graphs.flatten()
                pos = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_pydict({
                    "trace_id": batch.column("trace_id").take(pa.array(of)),
                    "pos": pa.array(pos, pa.int64()),
                    "from_id": edges.field("fromId"),
                    "to_id": edges.field("toId"),
                    "importance": pa.array(value[g.listed], pa.float64()),
                })

    keep = ["trace_id", "call_graph"] + (["has_features"] if fallback is not None else [])
    return rows.select(*keep).mapInArrow(
        explain, "trace_id string, pos long, from_id string, to_id string, importance double"
    )


def explain_edges(edges: DataFrame, weights: Weights, task_edges: int = TASK_EDGES) -> DataFrame:
    """``explain_graph`` of an edge table (trace_id, pos, from_id, to_id).

    A graph of at most ``task_edges`` distinct edges goes to one task as an array; larger ones
    are explained by joins and are never gathered in one place.
    """
    pairs = weighted_pairs(edges)
    sizes = pairs.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_e"))
    big = sizes.where(F.col("_e") > task_edges).select("trace_id")
    entry = F.struct(F.col("from_id").alias("fromId"), F.col("to_id").alias("toId"))
    small = pairs.join(big, "trace_id", "left_anti").groupBy("trace_id").agg(
        F.flatten(F.collect_list(F.array_repeat(entry, F.col("n").cast("int")))).alias("call_graph"))
    inside = explain_graph(small, weights).groupBy("trace_id", "from_id", "to_id").agg(
        F.max("importance").alias("importance"))
    joined = explain_pairs_joined(pairs.join(big, "trace_id", "left_semi"), weights)
    return edges.select("trace_id", "pos", "from_id", "to_id").join(
        inside.unionByName(joined), ["trace_id", "from_id", "to_id"]
    ).select("trace_id", "pos", "from_id", "to_id", "importance")


def explain_pairs_joined(pairs: DataFrame, weights: Weights) -> DataFrame:
    """Importance of weighted pairs (trace_id, from_id, to_id, n) of graphs of any size.

    Without the message s -> t the first layer changes at t only, by a number that follows from
    three numbers of s. So the edges into t are grouped by these before they meet the edges that
    leave t, and those are grouped by what they carry and where to: a hub costs its kinds of
    edges, not its pairs of edges. Nodes and edges are written once, as several joins read them.
    """
    if weights.depth > 2:
        raise ValueError("edges are explained for one or two layers")
    two = weights.depth == 2
    loops = pairs.where(F.col("from_id") == F.col("to_id")).select(
        "trace_id", "from_id", "to_id", F.lit(0.0).alias("importance"))
    nodes = _node_states(pairs, weights)
    graphs = nodes.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.avg(dot(F.col("h"), literal(weights.head[0]))).alias("z"))
    start = nodes.select("trace_id", F.col("node_id").alias("from_id"), F.col("x").alias("xs"),
                         F.col("root").alias("rs"), F.col("a").alias("as"))
    kind = ["xs", "rs", "as"]
    plain = pairs.where(F.col("from_id") != F.col("to_id"))
    edges = checkpointed(plain.join(start, ["trace_id", "from_id"]))
    target = nodes.select("trace_id", F.col("node_id").alias("to_id"), F.col("root").alias("rt"),
                          F.col("a").alias("at"), *(["s"] if two else []))
    kinds = edges.select("trace_id", "to_id", *kind).distinct().join(target, ["trace_id", "to_id"])
    kinds = kinds.withColumn("d", F.col("xs") / (F.col("rs") * F.col("rt")))
    own = _own_change(weights)
    if two:
        kinds = checkpointed(kinds.withColumn(
            "own", own(F.col("at"), F.col("d"), F.col("rs"), F.col("rt"), F.col("as"), F.col("s"))
        ).drop("s"))
        ends = nodes.select("trace_id", F.col("node_id").alias("to_id"), F.col("root").alias("ru"), "s")
        leaving = plain.join(ends, ["trace_id", "to_id"]).join(
            nodes.select("trace_id", F.col("node_id").alias("from_id"), "root"), ["trace_id", "from_id"])
        leaving = leaving.groupBy(
            "trace_id", F.col("from_id").alias("to_id"), "s",
            (F.col("n") / (F.col("root") * F.col("ru"))).alias("carried"),
        ).agg(F.count(F.lit(1)).alias("m"))
        further = kinds.select("trace_id", "to_id", *kind, "at", "d").join(leaving, ["trace_id", "to_id"])
        gone = _next_change(weights)(F.col("at"), F.col("d"), F.col("carried"), F.col("s")) * F.col("m")
        on = ["trace_id", "to_id", *kind]
        summed = further.select(*on, gone.alias("g")).groupBy(*on).agg(F.sum("g").alias("g"))
        kinds = kinds.join(summed, on, "left").withColumn("own", F.col("own") + F.coalesce("g", F.lit(0.0)))
    else:
        kinds = kinds.withColumn("own", own(F.col("at"), F.col("d")))
    logit = F.col("z") + F.lit(float(weights.head[1]))
    lost = 1.0 / (1.0 + F.exp(-logit)) - 1.0 / (1.0 + F.exp(-(logit + F.col("own") / F.col("nodes"))))
    valued = kinds.join(graphs, "trace_id").select(
        "trace_id", "to_id", *kind, F.greatest(F.lit(0.0), lost).alias("importance"))
    out = edges.join(valued, ["trace_id", "to_id", *kind]).select(
        "trace_id", "from_id", "to_id", "importance")
    return out.unionByName(loops)


def _node_states(pairs: DataFrame, weights: Weights) -> DataFrame:
    """``(trace_id, node_id, x, root, a, h[, s])`` of every node: input, root of the degree, input
    of the first layer, output of the last, and for two layers its input to the rectifier."""
    ends = pairs.select("trace_id", F.inline(F.array(
        F.struct(F.col("from_id").alias("node_id"), F.col("n").alias("x"), F.lit(0).alias("i")),
        F.struct(F.col("to_id").alias("node_id"), F.col("n").alias("x"),
                 F.when(F.col("from_id") != F.col("to_id"), F.col("n")).otherwise(0).alias("i")),
    )))
    nodes = ends.groupBy("trace_id", "node_id").agg(
        F.sum("x").cast("double").alias("x"), F.sum("i").alias("n_in")
    ).select("trace_id", "node_id", "x", F.sqrt(F.col("n_in") + 1.0).alias("root"))
    plain = pairs.where(F.col("from_id") != F.col("to_id"))

    def received(values: list[Column], names: list[str]) -> DataFrame:
        sent = nodes.select("trace_id", F.col("node_id").alias("from_id"),
                            *[(v / F.col("root")).alias(n) for v, n in zip(values, names)])
        return plain.join(sent, ["trace_id", "from_id"]).groupBy(
            "trace_id", F.col("to_id").alias("node_id")
        ).agg(*[F.sum(F.col("n") * F.col(n)).alias(f"r_{n}") for n in names])

    def whole(value: Column, name: str) -> Column:
        return (F.coalesce(F.col(f"r_{name}"), F.lit(0.0)) + value / F.col("root")) / F.col("root")

    nodes = nodes.join(received([F.col("x")], ["v"]), ["trace_id", "node_id"], "left").select(
        "trace_id", "node_id", "x", "root", whole(F.col("x"), "v").alias("a"))
    (w1, b1) = weights.layers[0]
    nodes = checkpointed(nodes)
    first = _vectors(lambda a: np.maximum(a @ w1 + b1, 0.0), w1.shape[1])(F.col("a"))
    if weights.depth == 1:
        return checkpointed(nodes.withColumn("h", first))
    nodes = nodes.withColumn("h1", first)
    width = w1.shape[1]
    values, names = [F.get("h1", F.lit(i)) for i in range(width)], [f"v{i}" for i in range(width)]
    w2, b2 = weights.layers[1]
    joined = nodes.join(received(values, names), ["trace_id", "node_id"], "left").withColumn(
        "a2", F.array(*[whole(v, n) for v, n in zip(values, names)]))
    second = _vectors(lambda a: a @ w2 + b2, w2.shape[1])(F.col("a2"))
    out = joined.select("trace_id", "node_id", "x", "root", "a", second.alias("s"))
    return checkpointed(out.withColumn("h", F.transform("s", lambda v: F.greatest(v, F.lit(0.0)))))


def _matrix(rows: pa.Array) -> np.ndarray:
    """Number or list columns as a matrix."""
    if not pa.types.is_list(rows.type) and not pa.types.is_large_list(rows.type):
        return np.asarray(rows)[:, None]
    return np.asarray(rows.flatten()).reshape(len(rows), -1)


def _vectors(call, width: int):
    """``call`` on a matrix of the rows of a batch, as a column of arrays."""
    def rows(values: pa.Array) -> pa.Array:
        out = call(_matrix(values)) if len(values) else np.zeros((0, width))
        ends = np.arange(0, out.size + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return F.arrow_udf(rows, "array<double>")


def _change(weights: Weights, a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Change of the first layer's output where its input ``a`` loses ``d``."""
    w, b = weights.layers[0]
    return np.maximum((a - d) @ w + b, 0.0) - np.maximum(a @ w + b, 0.0)


def _own_change(weights: Weights):
    """What an edge's end itself adds to the sum of the head when the message is left out."""
    if weights.depth == 1:
        return F.arrow_udf(lambda a, d: pa.array(
            _change(weights, _matrix(a), _matrix(d)) @ weights.head[0]), "double")
    (w1, b1), (w2, _) = weights.layers

    def own(a: pa.Array, d: pa.Array, rs: pa.Array, rt: pa.Array, source: pa.Array, s: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.float64())
        rs, rt, before = _matrix(rs), _matrix(rt), _matrix(s)
        sent = np.maximum(_matrix(source) @ w1 + b1, 0.0) @ w2
        new = before + _change(weights, _matrix(a), _matrix(d)) @ w2 / rt**2 - sent / (rs * rt)
        return pa.array((np.maximum(new, 0.0) - np.maximum(before, 0.0)) @ weights.head[0])

    return F.arrow_udf(own, "double")


def _next_change(weights: Weights):
    """What a node adds that gets ``carried`` times the change at the end of the cut edge."""
    w2 = weights.layers[1][0]

    def further(a: pa.Array, d: pa.Array, carried: pa.Array, s: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.float64())
        kinds, place = np.unique(np.hstack([_matrix(a), _matrix(d)]), axis=0, return_inverse=True)
        moved = _change(weights, kinds[:, :1], kinds[:, 1:]) @ w2
        before = _matrix(s)
        new = before + _matrix(carried) * moved[place.ravel()]
        return pa.array((np.maximum(new, 0.0) - np.maximum(before, 0.0)) @ weights.head[0])

    return F.arrow_udf(further, "double")


def edge_threshold(
    importances: DataFrame, share: float = 0.9, part_rows: int = PART_ROWS
) -> DataFrame:
    """The ``share`` percentile per graph, linearly interpolated.

    Two ranks per graph are read off the ordered rows, so a graph of any size is sorted in
    slices and never held in one buffer.
    """
    n = importances.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = in_order(
        importances.select("trace_id", "importance", "pos"), ["trace_id"], ["importance", "pos"],
        index="_i", part_rows=part_rows,
    ).join(n, "trace_id")
    place = (F.col("_n") - 1) * F.lit(share)
    ends = ranked.where(F.col("_i").between(F.floor(place), F.floor(place) + 1))
    part = F.max(place - F.floor(place))
    low, high = F.min("importance"), F.max("importance")
    return ends.groupBy("trace_id").agg(
        F.when(part >= 0.5, high - (high - low) * (1.0 - part))
        .otherwise(low + (high - low) * part).alias("threshold")
    )


def abnormal_edges(importances: DataFrame, share: float = 0.9, part_rows: int = PART_ROWS):
    """Edges at or above the percentile of their graph and above 0."""
    limit = edge_threshold(importances, share, part_rows)
    return importances.join(limit, "trace_id").where(
        (F.col("importance") >= F.col("threshold")) & (F.col("importance") > 0)
    )


def explain_batch(
    requests: DataFrame, results: DataFrame, scorer: ForestScorer, gcn: Weights,
    fallback: Weights, samples: int = SAMPLES,
) -> DataFrame:
    """One record per requested trace that is stored: weights map and abnormal edges.

    Records without features are explained by the one-layer net and have no weights.
    """
    found = explain_requests(requests, results).select(
        "trace_id",
        features_from_json(F.col("features_json")).alias("f"),
        F.coalesce(F.col("features_json").isNotNull() & (F.trim("features_json") != "{}"),
                   F.lit(False)).alias("has_features"),
        graph_from_json(F.col("call_graph_json")).alias("call_graph"),
    )
    rich = found.where("has_features").select("trace_id", "f.*")
    weights = top_weights(explain_forest(rich, scorer, samples)).groupBy("trace_id").agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature", "weight"))),
            lambda w: F.struct(w["feature"], w["weight"]),
        )).alias("lime_weights")
    )
    importances = explain_graph(found, gcn, fallback)
    # The record format holds the edges of one trace in one value.
    edges = abnormal_edges(importances).groupBy("trace_id").agg(
        F.transform(
            F.array_sort(F.collect_list(
                F.struct((-F.col("importance")).alias("v"), "pos", "from_id", "to_id")
            )),
            lambda e: F.struct(e["from_id"].alias("fromId"), e["to_id"].alias("toId"),
                               (-e["v"]).alias("importance")),
        ).alias("abnormal_edges")
    )
    return (
        found.select("trace_id")
        .join(weights, "trace_id", "left")
        .join(edges, "trace_id", "left")
        .select(
            "trace_id",
            F.lit(1).alias("status"),
            F.coalesce("lime_weights", F.create_map().cast(WEIGHTS)).alias("lime_weights"),
            F.coalesce("abnormal_edges", F.array().cast(ABNORMAL_EDGES)).alias("abnormal_edges"),
        )
    )
