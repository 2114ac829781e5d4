"""Random forest on prepared feature rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.records import fill_missing, label
from ..schemas import MODEL_INPUT, c
from .grids import parameter_grid
from .grow import Trees, bin_borders, binned, cell_sums
from .lineage import checkpointed, held, shared_folder
from .metrics import classification_metrics, pick_best
from .prepare import Preparation, fit_preparation
from .smote import smote

# The tuned forest and the search space (split size has no twin here).
TREES, DEPTH, SEED = 100, 10, 42
JUDGED_ROWS = 2000  # rows that walk all trees in one go
NODES_AT_ONCE = 150_000  # nodes of the trees that a search grows at once, as the driver holds them
SPARK_ROWS = 2000  # rows up to which Spark's trainer grows the trees of a search
TASK_BYTES = 128 << 20  # rows in bins that a task may hold; the trainer's job too if there are more
FOREST_GRID = {
    "n_estimators": [100, 200], "max_depth": [10, 20, 30], "max_features": ["sqrt", "log2"],
}


@dataclass
class ForestScorer:
    preparation: Preparation
    model: RandomForestClassificationModel

    def __call__(self, df: DataFrame, handle_unseen: str = "zero") -> DataFrame:
        return score_forest(df, self, handle_unseen)


def fit_forest(
    df: DataFrame, trees: int = TREES, depth: int = DEPTH, features: str = "sqrt",
    seed: int = SEED, max_bins: int = 32,
) -> RandomForestClassificationModel:
    """``df``: x (array), y. Depth is at most 30."""
    rows = df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("y"))
    classifier = RandomForestClassifier(
        featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy=features, seed=seed, maxBins=max_bins,
    )
    return classifier.fit(rows)


def train_forest(labelled: DataFrame, balance: bool = True, **forest) -> ForestScorer:
    """Prepare, balance and fit. ``labelled``: _id, feature columns, classification."""
    rows = fill_missing(labelled).withColumn("y", label(F.col("classification")))
    rows = checkpointed(rows.select("_id", *[c(n) for n in MODEL_INPUT], "y"))
    preparation = fit_preparation(rows)
    x = checkpointed(preparation.apply(rows).select("_id", "x", "y"))
    # The fit reads its rows several times: neighbours are looked for once.
    return ForestScorer(preparation, fit_forest(held(smote(x)) if balance else x, **forest))


def forest_probability(df: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add ``rf_prob``, the probability of class 1, to rows with the input array ``x``."""
    scored = model.transform(df.withColumn("features", array_to_vector("x")))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("rf_prob"))


def score_forest(df: DataFrame, scorer: ForestScorer, handle_unseen: str = "zero") -> DataFrame:
    """Add ``rf_prob``; rows without features (``has_features`` false) get 0.0."""
    out = forest_probability(scorer.preparation.apply(df, handle_unseen), scorer.model).drop("x")
    if "has_features" in df.columns:
        out = out.withColumn("rf_prob", F.when(F.col("has_features"), F.col("rf_prob"))
                             .otherwise(F.lit(0.0)))
    return out


def feature_importances(scorer: ForestScorer, spark) -> DataFrame:
    """Importance of every feature with its rank, the most important first; as many rows as
    the model has features."""
    pairs = zip(scorer.preparation.columns, scorer.model.featureImportances.toArray().tolist())
    ranked = sorted(pairs, key=lambda p: (-p[1], p[0]))
    rows = [(name, value, rank) for rank, (name, value) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def grown_trees(model: RandomForestClassificationModel, spark) -> Trees:
    """The trees of a fitted forest of two classes, read from its stored form; as many rows as
    the model, which is on the driver anyway, has nodes. Arrow keeps them small on the way."""
    folder = shared_folder(spark, "forest")
    model.write().overwrite().save(folder)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{folder}/data").select(
        "treeID", n["id"], n["split"]["featureIndex"], F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)),
        n["leftChild"], n["rightChild"], n["impurityStats"][0], n["impurityStats"][1],
    ).toDF("tree", "id", "feature", "threshold", "left", "right", "n0", "n1").orderBy("tree", "id").toArrow()
    number = lambda name: rows[name].fill_null(0).to_numpy()
    tree, inner = number("tree"), number("left") >= 0
    roots = np.searchsorted(tree, np.arange(tree[-1] + 1))
    base = roots[tree]  # ids count from 0 in every tree, in the order of the rows
    return Trees(
        roots, np.where(inner, number("feature"), -1), number("threshold").astype(float),
        base + number("left"), base + number("right"),
        number("n1") / np.maximum(number("n0") + number("n1"), 1e-300),
    )


def grown_in_groups(train: DataFrame, count: int, depth: int, features: str, seed: int):
    """The trees of a forest in groups, each with the number of its first tree.

    A group has about ``NODES_AT_ONCE`` nodes or is one tree. The first is cut by what ``train``
    allows at most, a later one by the largest tree so far; each group draws from its own seed.
    """
    rows, first = train.count(), 0
    nodes = min(2 ** (depth + 1), 2 * rows)
    while first < count:
        size = min(count - first, max(1, NODES_AT_ONCE // max(nodes, 1)))
        trees = grown_trees(fit_forest(train, size, depth, features, seed + first), train.sparkSession)
        yield first, trees
        largest = int(np.diff(np.append(trees.roots, len(trees.feature))).max())
        nodes, first = largest if first == 0 else max(nodes, largest), first + size


def _cell_sums(trees: Trees, first: int, sizes: list[tuple[int, int]], depths: list[int]):
    """Sums of the probabilities of ``trees``, numbered from ``first``, over the trees of every
    (number of trees, depth), as an array column."""
    def sums(rows: pa.Array) -> pa.Array:
        x = np.asarray(rows.flatten(), float).reshape(len(rows), -1)
        parts = [np.zeros((0, len(sizes)))]
        for low in range(0, len(x), JUDGED_ROWS):
            found = trees.at_depths(x[low : low + JUDGED_ROWS], depths)
            parts.append(np.stack(
                [found[depths.index(d), :, : max(0, t - first)].sum(axis=1) for t, d in sizes], axis=1))
        flat = np.concatenate(parts)
        ends = np.arange(0, flat.size + 1, len(sizes), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    return F.arrow_udf(sums, "array<double>")


def _sums_in_groups(train: DataFrame, val: DataFrame, sizes, features: str, seed: int) -> DataFrame:
    """Rows of ``val`` (y, sums), judged by Spark's trees in groups that the driver can hold."""
    depths = sorted({d for _, d in sizes})
    judged = None
    for first, trees in grown_in_groups(train, max(t for t, _ in sizes), depths[-1], features, seed):
        sums = _cell_sums(trees, first, sizes, depths)(F.col("x"))
        if judged is None:
            judged = val.withColumn("sums", sums)
        else:
            # The groups before are written, so that no plan holds their trees.
            judged = checkpointed(judged).withColumn("_more", sums).select(
                "x", "y", F.zip_with("sums", "_more", lambda a, b: a + b).alias("sums"))
    return judged


def search_forest(train: DataFrame, val: DataFrame, grid=None, seed: int = SEED) -> DataFrame:
    """Validation metrics of every forest of the grid. Both tables: x, y.

    Only the largest and deepest forest of each ``max_features`` is grown: a smaller one is its
    first trees, a shallower one its trees cut at their depth. All cells are judged in one pass
    over ``val``. Up to ``SPARK_ROWS`` Spark's trainer grows the trees, beyond that tasks that
    hold both tables in bins, and again the trainer if these are too large for a task.
    """
    grid = grid or FOREST_GRID
    spark = train.sparkSession
    train, val = checkpointed(train.select("x", "y")), checkpointed(val.select("x", "y"))
    numbers = {k: v for k, v in grid.items() if k != "max_features"}
    sizes = [(int(r["n_estimators"]), int(r["max_depth"]))
             for r in parameter_grid(spark, numbers).orderBy("cell").collect()]
    kinds = grid["max_features"]
    cells = [(k * len(kinds) + j, trees, depth, f)
             for k, (trees, depth) in enumerate(sizes) for j, f in enumerate(kinds)]
    rows, width = train.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    in_tasks = rows > SPARK_ROWS and (rows + val.count()) * (width + 1) <= TASK_BYTES
    if in_tasks:
        borders = bin_borders(train)
        sent = spark.sparkContext.broadcast((binned(train, borders), binned(val, borders, judged=True)))
    out = None
    for j, features in enumerate(kinds):
        if in_tasks:
            judged = checkpointed(cell_sums(sent, spark, sizes, features, seed))
        else:
            judged = _sums_in_groups(train, val, sizes, features, seed)
        sizes_of = F.array(*[F.lit(t) for t, _ in sizes])
        judged = judged.select("y", F.posexplode("sums").alias("k", "sum")).select(
            (F.col("k") * len(kinds) + j).cast("long").alias("cell"), "y",
            (F.col("sum") / F.get(sizes_of, F.col("k")) > 0.5).cast("int").alias("predicted"))
        out = judged if out is None else out.unionByName(judged)
    if in_tasks:
        sent.destroy()
    named = spark.createDataFrame(cells, "cell long, n_estimators int, max_depth int, max_features string")
    return named.join(F.broadcast(classification_metrics(out, ["cell"])), "cell")  # a row a cell


def best_forest(search: DataFrame) -> DataFrame:
    return pick_best(search)
