"""Graph network over call graphs: scoring at any graph size, and fitting."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph_batch import Weights, forward, gradients, initial_weights, make_batch
from .graphs import weighted_pairs
from .grids import parameter_grid
from .lineage import checkpointed, held
from .metrics import classification_metrics, pick_best

TASK_EDGES = 200_000  # distinct edges up to which a graph is scored inside one task
BATCH_EDGES = 32_000  # edges that are scored in one go inside a task: 64 numbers for each in several arrays
# Training settings and search spaces.
HIDDEN, RATE, EPOCHS = 64, 0.005, 10
GCN_GRID = {"hidden_channels": [32, 64, 128], "learning_rate": [0.001, 0.005, 0.01]}
EPOCH_CANDIDATES = [10, 15, 20, 25]


def _pieces(batch, lengths):
    """Slices of a batch or array with about ``BATCH_EDGES`` edges each."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= BATCH_EDGES:
            yield batch.slice(lo, i + 1 - lo)
            lo, total = i + 1, 0
    if lo < len(lengths):
        yield batch.slice(lo)


def graph_lengths(graphs: pa.Array) -> np.ndarray:
    return np.asarray(graphs.value_lengths().fill_null(0))


def row_pieces(batch: pa.RecordBatch, column: str = "call_graph"):
    return _pieces(batch, graph_lengths(batch.column(column)))


def graph_probability(
    graph: Column, weights: Weights, fallback: Weights | None = None,
    has_features: Column | None = None, counts: bool = False,
) -> Column:
    """Probability of a call-graph array; 0.0 without edges.

    Only the graphs travel to Python, as Arrow arrays; all other columns stay in the JVM.
    With ``fallback`` (the one-layer net) rows without features are scored by it.
    """
    def probability(graphs: pa.Array, rich: pa.Array) -> pa.Array:
        lengths = graph_lengths(graphs)
        parts = [np.zeros(0)]
        for piece in _pieces(graphs, lengths):
            g = make_batch(piece, counts)
            p = forward(g, weights, even=True)[0]
            if fallback is not None:
                mine = np.asarray(rich.slice(sum(map(len, parts)), len(p)).fill_null(False))
                p = np.where(mine, p, forward(g, fallback, even=True)[0])
            parts.append(p)
        return pa.array(np.concatenate(parts), pa.float64())

    call = F.arrow_udf(probability, "double")
    return call(graph, F.lit(True) if has_features is None else has_features)


def score_call_graphs(
    df: DataFrame, weights: Weights, graph: str = "call_graph", name: str = "gcn_prob",
    fallback: Weights | None = None, counts: bool = False,
) -> DataFrame:
    """Add the graph probability to rows that hold their graph. No shuffle; also on streams."""
    rich = F.col("has_features") if fallback is not None else None
    return df.withColumn(
        name, graph_probability(F.col(graph), weights, fallback, rich, counts)
    )


def score_edges(edges: DataFrame, weights: Weights, task_edges: int = TASK_EDGES) -> DataFrame:
    """Probability per graph of an edge table.

    Parallel edges are counted first. A graph then goes to one task as an array if it has
    at most ``task_edges`` distinct edges; larger graphs are scored by joins, layer by
    layer, and are never gathered in one place.
    """
    pairs = weighted_pairs(edges)
    sizes = pairs.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_e"))
    big = sizes.where(F.col("_e") > task_edges).select("trace_id")
    small = pairs.join(big, "trace_id", "left_anti")
    entry = F.struct(F.col("from_id").alias("fromId"), F.col("to_id").alias("toId"), "n")
    packed = small.groupBy("trace_id").agg(F.collect_list(entry).alias("_g"))
    scored = score_call_graphs(packed, weights, graph="_g", counts=True).drop("_g")
    return scored.unionByName(score_pairs_joined(pairs.join(big, "trace_id", "left_semi"), weights))


def score_pairs_joined(pairs: DataFrame, weights: Weights) -> DataFrame:
    """Layer-by-layer scoring of weighted pairs with one row per node; sums are plain columns."""
    ends = pairs.select("trace_id", F.inline(F.array(
        F.struct(F.col("from_id").alias("node_id"), F.col("n").alias("x"), F.lit(0).alias("i")),
        F.struct(F.col("to_id").alias("node_id"), F.col("n").alias("x"),
                 F.when(F.col("from_id") != F.col("to_id"), F.col("n")).otherwise(0).alias("i")),
    )))
    nodes = ends.groupBy("trace_id", "node_id").agg(
        F.sum("x").cast("double").alias("x"), F.sum("i").alias("n_in")
    ).select("trace_id", "node_id", F.sqrt(F.col("n_in") + 1.0).alias("root"),
             F.array("x").alias("h"))
    pairs = pairs.where(F.col("from_id") != F.col("to_id"))
    width = 1
    for w, b in weights.layers:
        sent = nodes.select(
            "trace_id", F.col("node_id").alias("from_id"),
            *[(F.get("h", F.lit(i)) / F.col("root")).alias(f"s{i}") for i in range(width)],
        )
        received = pairs.join(sent, ["trace_id", "from_id"]).groupBy(
            "trace_id", F.col("to_id").alias("node_id")
        ).agg(*[F.sum(F.col("n") * F.col(f"s{i}")).alias(f"r{i}") for i in range(width)])
        joined = nodes.join(received, ["trace_id", "node_id"], "left")
        a = F.array(*[
            (F.coalesce(F.col(f"r{i}"), F.lit(0.0)) + F.get("h", F.lit(i)) / F.col("root"))
            / F.col("root")
            for i in range(width)
        ])
        nodes = joined.select("trace_id", "node_id", "root", _dense(w, b)(a).alias("h"))
        width = w.shape[1]
    head = literal(weights.head[0])
    pooled = nodes.groupBy("trace_id").agg(F.avg(dot(F.col("h"), head)).alias("z"))
    z = F.col("z") + F.lit(float(weights.head[1]))
    return pooled.select("trace_id", (1.0 / (1.0 + F.exp(-z))).alias("gcn_prob"))


def literal(values) -> Column:
    """A weight vector or matrix as one constant array column."""
    values = np.asarray(values, dtype=float)
    kind = "array<" * values.ndim + "double" + ">" * values.ndim
    return F.from_json(F.lit(json.dumps(values.tolist())), kind)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _dense(w: np.ndarray, b: np.ndarray):
    """Rectified linear layer on array columns, row by row in Arrow batches."""
    def layer(rows: pa.Array) -> pa.Array:
        x = np.asarray(rows.flatten()).reshape(len(rows), w.shape[0])
        h = np.maximum(x @ w + b, 0.0)
        ends = np.arange(0, h.size + 1, w.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(h.ravel()))

    return F.arrow_udf(layer, "array<double>")


class Adam:
    def __init__(self, rate, beta1=0.9, beta2=0.999, eps=1e-8):
        self.rate, self.beta1, self.beta2, self.eps = rate, beta1, beta2, eps
        self.m = self.v = 0.0
        self.step = 0

    def __call__(self, w, g):
        self.step += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        m = self.m / (1 - self.beta1**self.step)
        v = self.v / (1 - self.beta2**self.step)
        return w - self.rate * m / (np.sqrt(v) + self.eps)


BATCH = 32  # graphs of a step
# A shard is what one task fits on between two averages: graphs, and edges on average.
SHARD_GRAPHS, SHARD_EDGES = 1024, 1_000_000
# Tasks of an epoch: one for each shard up to the first number, then one for this many shards,
# which it fits one after the other and adds up, so that fewer weights are shuffled.
LEAST_TASKS, TASK_SHARDS = 96, 8
LAID_OUT_EDGES = 250_000  # edges up to which a shard is laid out as a whole, else batch by batch


def summed(df: DataFrame, call, size: int) -> np.ndarray:
    """Sum over the partitions of ``df`` of the vectors ``call(batch)`` gives.

    ``call`` maps a record batch to an array of ``size``. Each partition adds up its own, the
    partitions are added per component on the executors, and the driver receives ``size``
    numbers.
    """
    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += call(batch)
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tolist()])})

    sums = df.mapInArrow(part, "g array<double>")
    return _added(sums.select(F.posexplode("g").alias("i", "v")), size)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of ``parts (i, v)`` per component."""
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


@dataclass
class Net:
    """Settings of a net to fit."""

    hidden: int = HIDDEN
    depth: int = 2
    rate: float = RATE


def training_shards(
    graphs: DataFrame, seed: int, batch: int
) -> tuple[DataFrame, int, int]:
    """Graphs with edges as ``(shard, place, call_graph, y)``, their number and the positives.

    The table is written with all rows of a shard together in one partition, so an epoch moves
    none of them. Shards follow from the id, not from how the rows were dealt.
    """
    rows = checkpointed(
        graphs.where(F.size("call_graph") > 0).select("_id", "call_graph", "y")
    )
    total, positive, edges = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("y") == 1, 1)), F.sum(F.size("call_graph"))
    ).first()
    shards = max(1, -(-total // max(SHARD_GRAPHS, batch)), -(-(edges or 0) // SHARD_EDGES))
    place = F.xxhash64("_id", F.lit(seed))
    sharded = rows.select(
        F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard"),
        place.alias("place"), "call_graph", "y",
    )
    tasks = min(shards, max(LEAST_TASKS, -(-shards // TASK_SHARDS)))
    dealt = sharded.repartition(tasks, "shard").sortWithinPartitions("shard", "place")
    return held(dealt), total, positive


def whole_shards(batches):
    """The rows of each shard of a partition as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = np.asarray(batch.column("shard"))
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            if held and held[0].column("shard")[0].as_py() != shards[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def local_steps(
    table: pa.Table, states: list[np.ndarray], shapes: list[Weights], rates: list[float],
    batch: int, factor: float, seed: int, epoch: int,
) -> list[np.ndarray]:
    """One epoch of Adam steps of every net over the graphs of a shard, from ``states``.

    A state holds the weights, both moments and the number of steps. Every net takes the same
    batches, in an order drawn anew for each epoch; a shard is laid out once for all of them.
    """
    table = table.combine_chunks()
    shard = table["shard"][0].as_py()
    order = np.random.default_rng([seed % (1 << 32), epoch, shard]).permutation(len(table))
    y = np.asarray(table["y"]).astype(float)
    graphs = table["call_graph"].combine_chunks()
    whole = make_batch(graphs) if graph_lengths(graphs).sum() <= LAID_OUT_EDGES else None
    adams = []
    for state, shape, rate in zip(states, shapes, rates):
        flat, m, v = np.split(state[:-1], 3)
        adam = Adam(rate)
        adam.m, adam.v, adam.step = m, v, state[-1]
        adams.append((adam, shape, flat))
    for low in range(0, len(order), batch):
        rows = order[low : low + batch]
        laid_out = make_batch(graphs.take(pa.array(rows))) if whole is None else whole.picked(rows)
        labels = y[rows]
        for k, (adam, shape, flat) in enumerate(adams):
            g, _, n = gradients(laid_out, shape.like(flat), labels, factor)
            adams[k] = (adam, shape, adam(flat, g / n))
    return [np.concatenate([flat, adam.m, adam.v, [adam.step]]) for adam, _, flat in adams]


def fit_gcns(
    graphs: DataFrame, nets: list[Net], epochs: int = EPOCHS,
    pos_weight: float | str | None = None, batches: int | None = None, seed: int = 42,
    snapshots: list[int] | None = None, batch: int = BATCH,
) -> list[Weights] | dict[int, list[Weights]]:
    """Adam on cross entropy for several nets at once. ``graphs``: _id, call_graph, y; graphs
    without edges are left out.

    An epoch is one Spark job, whatever the number of graphs and nets. Every shard takes its
    own steps over batches of ``batch`` graphs (or ``batches`` of them in all), and the weights
    and moments of the shards are averaged by their graphs; up to ``SHARD_GRAPHS`` graphs there
    is one shard, and the steps follow each other as in plain training.
    ``pos_weight`` "balanced" weights positives by negatives / (positives + 1e-5).
    ``snapshots`` asks for the weights after several epoch counts of one run.
    """
    if batches:
        held = graphs.where(F.size("call_graph") > 0).count()
        batch = max(1, -(-held // batches))
    sharded, total, positive = training_shards(graphs, seed, batch)
    if pos_weight == "balanced":
        pos_weight = (total - positive) / (positive + 1e-5)
    factor = 1.0 if pos_weight is None else float(pos_weight)
    shapes = [initial_weights(n.hidden, n.depth, seed) for n in nets]
    flats = [w.flat() for w in shapes]
    states = [np.concatenate([f, np.zeros(2 * f.size + 1)]) for f in flats]
    rates = [n.rate for n in nets]
    ends = np.cumsum([s.size for s in states])
    kept = {}

    def done() -> list[Weights]:
        return [w.like(s[: f.size].copy()) for w, f, s in zip(shapes, flats, states)]

    for epoch in range(1, epochs + 1):
        if total:
            def steps(rows, now=states, epoch=epoch):
                added = None
                for table in whole_shards(rows):
                    out = local_steps(table, now, shapes, rates, batch, factor, seed, epoch)
                    out = np.concatenate(out) * (len(table) / total)
                    added = out if added is None else added + out
                if added is not None:
                    yield pa.RecordBatch.from_pydict({"s": pa.array([added])})

            parts = sharded.mapInArrow(steps, "s array<double>")
            averaged = _added(parts.select(F.posexplode("s").alias("i", "v")), int(ends[-1]))
            states = np.split(averaged, ends[:-1])
        if snapshots and epoch in snapshots:
            kept[epoch] = done()
    return kept if snapshots else done()


def fit_gcn(
    graphs: DataFrame, hidden: int = HIDDEN, depth: int = 2, epochs: int = EPOCHS,
    rate: float = RATE, pos_weight: float | str | None = None, batches: int | None = None,
    seed: int = 42, snapshots: list[int] | None = None, batch: int = BATCH,
) -> Weights | dict[int, Weights]:
    """One net, as ``fit_gcns`` fits it."""
    out = fit_gcns(
        graphs, [Net(hidden, depth, rate)], epochs, pos_weight, batches, seed, snapshots, batch)
    return {n: w[0] for n, w in out.items()} if snapshots else out[0]


def score_nets(df: DataFrame, nets: list[Weights], graph: str = "call_graph") -> DataFrame:
    """``df`` with ``gcn_probs``, the probability of every net; a graph is laid out once."""
    def probabilities(graphs: pa.Array) -> pa.Array:
        parts = [np.zeros((0, len(nets)))]
        for piece in _pieces(graphs, graph_lengths(graphs)):
            laid_out = make_batch(piece)
            parts.append(np.stack([forward(laid_out, w)[0] for w in nets], axis=1))
        found = np.concatenate(parts)
        ends = np.arange(0, found.size + 1, len(nets), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.withColumn("gcn_probs", F.arrow_udf(probabilities, "array<double>")(F.col(graph)))


def judge_nets(val: DataFrame, nets: list[Weights]) -> DataFrame:
    """Validation metrics of every net by ``cell``, its place in ``nets``: one pass over ``val``."""
    scored = score_nets(val.select("_id", "call_graph", "y"), nets)
    judged = scored.select("y", F.posexplode("gcn_probs").alias("cell", "gcn_prob")).select(
        F.col("cell").cast("long").alias("cell"), "y",
        (F.col("gcn_prob") > 0.5).cast("int").alias("predicted"),
    )
    return classification_metrics(judged, ["cell"])


def search_gcn(
    train: DataFrame, val: DataFrame, grid=None, depth: int = 2, epochs: int = EPOCHS, **fit
) -> DataFrame:
    """Validation metrics of every (hidden size, learning rate), all fitted in the same jobs."""
    spark = train.sparkSession
    cells = parameter_grid(spark, grid or GCN_GRID).orderBy("cell").collect()
    nets = [Net(int(r["hidden_channels"]), depth, r["learning_rate"]) for r in cells]
    named = spark.createDataFrame(
        [(r["cell"], n.hidden, n.rate) for r, n in zip(cells, nets)],
        "cell long, hidden_channels int, learning_rate double",
    )
    metrics = judge_nets(val, fit_gcns(train, nets, epochs, **fit))
    return named.join(F.broadcast(metrics), "cell")  # a row for each cell on both sides


def search_epochs(
    train: DataFrame, val: DataFrame, candidates=EPOCH_CANDIDATES, **fit
) -> tuple[DataFrame, dict[int, Weights]]:
    """Validation metrics after each candidate epoch count (``cell``), from one training run."""
    kept = fit_gcn(train, epochs=max(candidates), snapshots=list(candidates), **fit)
    counts = sorted(kept)
    metrics = judge_nets(val, [kept[n] for n in counts])
    number = F.get(F.array(*[F.lit(n).cast("long") for n in counts]), F.col("cell"))
    return metrics.withColumn("cell", number), kept


def best_gcn(search: DataFrame) -> DataFrame:
    return pick_best(search)
