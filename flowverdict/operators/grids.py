"""Searches over fusion parameters: every cell of a grid in one job.

The cell verdicts of one row depend on few parameters at a time. A row where both models
agree depends on ``alpha`` alone. A row where they disagree takes one of three weights,
chosen by its confidences, and its fused probability is then compared with a ladder of
shifted thresholds; how many rungs it passes says all about that parameter. So the rows
are counted per (kind of row, confidence limit, weight, rungs), and the few counts are
added up per cell. The rows never meet the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fusion as fu
from .metrics import with_ratios

# The search spaces, in loop order.
ALPHAS = [0.20, 0.25, 0.30, 0.33, 0.35, 0.40, 0.45, 0.50]
CONF_THRESHOLDS = [0.4, 0.5, 0.6, 0.7, 0.8]
HIGH_WEIGHTS = [0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
LOW_WEIGHTS = [0.10, 0.15, 0.20, 0.25, 0.30]
RF_SHIFTS = [0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25]
GCN_SHIFTS = [0.03, 0.05, 0.08, 0.10, 0.12, 0.15]
FIXED_ALPHAS = [i / 100 for i in range(101)]

STRATEGY1 = {
    "alpha": ALPHAS, "conf_threshold": CONF_THRESHOLDS,
    "weight_high_conf": HIGH_WEIGHTS, "weight_low_conf": LOW_WEIGHTS,
}
STRATEGY2 = {"threshold_adjust_rf": RF_SHIFTS, "threshold_adjust_gcn": GCN_SHIFTS}
DUAL = STRATEGY1 | STRATEGY2


def parameter_grid(
    spark, space: dict[str, list[float]], positions: bool = False
) -> DataFrame:
    """All combinations in loop order, numbered by ``cell`` from 0.

    Built from ``range``, so a large grid is made in parallel on the executors.
    """
    total = reduce(lambda a, b: a * b, (len(v) for v in space.values()), 1)
    out = spark.range(total).select(F.col("id").alias("cell"))
    block = total
    for name, values in space.items():
        block //= len(values)
        position = F.pmod(F.floor(F.col("cell") / block), F.lit(len(values))).cast("int")
        literal = F.array(*[F.lit(float(v)) for v in values])
        out = out.withColumn(name, F.get(literal, position))
        if positions:
            out = out.withColumn(f"_{name}", position)
    return out


def cross_with_grid(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Every row with every cell of a grid (column ``cell`` from 0, as ``parameter_grid``).

    Rows are repeated by cell number and joined on it: an equi join, so the planner
    broadcasts a small grid and shuffles by cell beyond that. The searches below do not
    use it; they reach the same metrics without repeating rows.
    """
    cells = params.count()
    repeated = scores.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return repeated.withColumn("cell", F.col("cell").cast("long")).join(params, "cell")


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores over all cores: every row is about to be judged
    hundreds of times. Other tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


FIXED_SLOTS = 10  # alphas judged per row and pass: keeps the generated method small


def search_fixed(scores: DataFrame, by=("gcn_layers",), alphas=FIXED_ALPHAS) -> DataFrame:
    """Metrics of every (group, alpha). ``scores``: by, rf_prob, gcn_prob, y.

    Each row meets the alphas ten at a time and only counts its positives, so the table is
    read once and shuffled as a few rows of counts per group.
    """
    alphas = [float(a) for a in alphas]
    slots = range(min(FIXED_SLOTS, len(alphas)))
    parts = [alphas[i : i + len(slots)] for i in range(0, len(alphas), len(slots))]
    parts[-1] += [float("nan")] * (len(slots) - len(parts[-1]))
    table = F.array(*[
        F.struct(F.lit(i).alias("_part"), *[F.lit(p[k]).alias(f"_a{k}") for k in slots])
        for i, p in enumerate(parts)
    ])
    rows = spread(scores.where(
        F.col("y").isin(0, 1) & F.col("rf_prob").isNotNull() & F.col("gcn_prob").isNotNull()
    )).select(*by, "y", "rf_prob", "gcn_prob", F.inline(table))
    rf, gcn = F.col("rf_prob"), F.col("gcn_prob")
    counts = rows.groupBy(*by, "y", "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.first(f"_a{k}").alias(f"_a{k}") for k in slots],
        *[F.count_if(fu.weighted(rf, gcn, F.col(f"_a{k}")) > 0.5).alias(f"_p{k}") for k in slots],
    )
    cells = counts.select(*by, "y", "_n", F.inline(F.array(*[
        F.struct(F.col(f"_a{k}").alias("alpha"), F.col(f"_p{k}").alias("p")) for k in slots
    ]))).where(~F.isnan("alpha"))

    def total(y, col, name):
        return F.coalesce(F.sum(F.when(F.col("y") == y, col)), F.lit(0)).alias(name)

    negative = F.col("_n") - F.col("p")
    return with_ratios(cells.groupBy(*by, "alpha").agg(
        total(0, negative, "tn"), total(0, F.col("p"), "fp"),
        total(1, negative, "fn"), total(1, F.col("p"), "tp"),
    ))


AGREE, RF_ALONE, GCN_ALONE = 0, 1, 2
# In the order of ``fusion.weight_choice``.
SHIFTS = ("threshold_adjust_rf", "threshold_adjust_gcn")
SOURCES = ["alpha", "weight_high_conf", "weight_low_conf"]


def _rungs(fused, kind, space):
    """How many of the thresholds of its kind a fused probability exceeds."""
    def passed(name, sign):
        limits = [F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.lit(0.5) + F.lit(sign * float(v))))
                  for v in space.get(name, [0.0])]
        return reduce(lambda a, b: a + b, [(fused > x).cast("int") for x in limits])

    return (
        F.when(kind == AGREE, (fused > 0.5).cast("int"))
        .when(kind == RF_ALONE, passed("threshold_adjust_rf", 1))
        .otherwise(passed("threshold_adjust_gcn", -1))
    )


def search_cells(
    scores: DataFrame, space: dict[str, list[float]], fixed_alpha: float = 0.0
) -> DataFrame:
    """Metrics of every cell of strategy 1, strategy 2 or both (the keys of ``space``).

    The values of a parameter may come in any order; cells are numbered as they come.
    """
    given = space
    space = {n: sorted(map(float, v)) if n in SHIFTS else v for n, v in given.items()}
    spark = scores.sparkSession
    rf, gcn = F.col("rf_prob"), F.col("gcn_prob")
    confs = space.get("conf_threshold", [])
    weights = {
        i: [float(v) for v in space[n]] if n in space else [float(fixed_alpha)]
        for i, n in enumerate(SOURCES) if n in space or i == 0
    }
    kind = (
        F.when(fu.hard(rf) == fu.hard(gcn), AGREE).when(fu.hard(rf) > fu.hard(gcn), RF_ALONE)
        .otherwise(GCN_ALONE)
    )
    rows = spread(scores.where(F.col("y").isin(0, 1) & rf.isNotNull() & gcn.isNotNull())).select(
        "rf_prob", "gcn_prob", "y", kind.alias("kind"),
        fu.confidence(rf).alias("sure_rf"), fu.confidence(gcn).alias("sure_gcn"))

    def choice(position, source):
        return F.struct(F.lit(position).alias("conf"), source.alias("source"))

    choices = [choice(0, F.lit(0))]
    if confs:
        sure = F.col("sure_rf"), F.col("sure_gcn")
        choices = [choice(i, fu.weight_choice(*sure, x)) for i, x in enumerate(confs)]
    rows = rows.select("rf_prob", "gcn_prob", "y", "kind", F.inline(
        F.when(F.col("kind") == AGREE, F.array(choice(0, F.lit(0)))).otherwise(F.array(*choices))
    ))
    entries = [(source, i, w) for source, values in weights.items() for i, w in enumerate(values)]
    table = spark.createDataFrame(entries, "source int, place int, weight double")
    fused = fu.weighted(rf, gcn, F.col("weight"))
    counts = (
        rows.join(F.broadcast(table), "source")  # as many rows as the grid has weights
        .withColumn("rungs", _rungs(fused, F.col("kind"), space))
        .groupBy("kind", "source", "conf", "place", "rungs")
        .agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    )

    # From rungs to the positions of the shifts: raising the forest's threshold loses the
    # higher rungs first, lowering the graph net's gains them last.
    n_rf = len(space.get("threshold_adjust_rf", [0]))
    n_gcn = len(space.get("threshold_adjust_gcn", [0]))
    shifts = F.when(F.col("kind") == RF_ALONE, n_rf).when(F.col("kind") == GCN_ALONE, n_gcn)
    by_shift = counts.withColumn("shift", F.explode(F.sequence(
        F.lit(0), F.coalesce(shifts, F.lit(1)) - 1)))
    hit = F.when(F.col("kind") == GCN_ALONE, F.col("shift") >= n_gcn - F.col("rungs")).otherwise(
        F.col("shift") < F.col("rungs"))
    part = by_shift.groupBy("kind", "source", "conf", "place", "shift").agg(
        F.sum(F.when(~hit, F.col("n0")).otherwise(0)).alias("tn"),
        F.sum(F.when(hit, F.col("n0")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("n1")).otherwise(0)).alias("fn"),
        F.sum(F.when(hit, F.col("n1")).otherwise(0)).alias("tp"),
    )

    grid = parameter_grid(spark, given, positions=True)

    def at(name):
        if name not in space:
            return F.lit(0)
        if name not in SHIFTS:
            return F.col(f"_{name}")
        ranks = [space[name].index(float(v)) for v in given[name]]
        return F.get(F.array(*map(F.lit, ranks)), F.col(f"_{name}"))

    def key(kind, source):
        shift = {AGREE: F.lit(0), RF_ALONE: at("threshold_adjust_rf"),
                 GCN_ALONE: at("threshold_adjust_gcn")}[kind]
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(source).alias("source"),
            (F.lit(0) if kind == AGREE else at("conf_threshold")).alias("conf"),
            at(SOURCES[source]).alias("place"), shift.alias("shift"),
        )

    needed = [key(AGREE, 0)] + [key(k, s) for k in (RF_ALONE, GCN_ALONE) for s in weights]
    names = ["cell", *space]
    wide = grid.select(*names, F.inline(F.array(*needed)))
    # One row per part cell, so these counts travel and the grid stays in place.
    cells = (
        wide.join(F.broadcast(part), ["kind", "source", "conf", "place", "shift"], "left")
        .groupBy(*names)
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n)
               for n in ("tn", "fp", "fn", "tp")])
    )
    if "alpha" not in space:
        cells = cells.withColumn("alpha", F.lit(float(fixed_alpha)))
    return with_ratios(cells)


def search_strategy1(scores: DataFrame, space=STRATEGY1) -> DataFrame:
    return search_cells(scores, space)


def search_strategy2(
    scores: DataFrame, space=STRATEGY2, alpha: float = fu.EXPERIMENT_FIXED_ALPHA
) -> DataFrame:
    return search_cells(scores, space, fixed_alpha=alpha)


def search_dual(scores: DataFrame, space=DUAL) -> DataFrame:
    return search_cells(scores, space)
