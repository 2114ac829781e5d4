"""Evaluation tables: confusion counts, ratios, distributions and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add the six ratios and class totals to a table with tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": _ratio(fp, fp + tn),
            "fnr": _ratio(fn, fn + tp),
            "normal_count": tn + fp,
            "anomaly_count": fn + tp,
        }
    )


def confusion(y: Column, predicted: Column, n: Column | None = None) -> list[Column]:
    n = F.lit(1) if n is None else n

    def total(hit, name):
        return F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).cast("long").alias(name)

    return [
        total((y == 0) & (predicted == 0), "tn"),
        total((y == 0) & (predicted == 1), "fp"),
        total((y == 1) & (predicted == 0), "fn"),
        total((y == 1) & (predicted == 1), "tp"),
    ]


def classification_metrics(
    df: DataFrame, by: list[str] | None = None, y: str = "y", predicted: str = "predicted"
) -> DataFrame:
    return with_ratios(df.groupBy(*(by or [])).agg(*confusion(F.col(y), F.col(predicted))))


def class_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def score_distribution(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    stats = []
    for name in columns:
        stats += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return df.groupBy(*by).agg(*stats)


def run_stability(metrics: DataFrame, by: list[str], run: str, limit: float = 0.05) -> DataFrame:
    """Spread of f1 over repeated runs and the best run (smallest name on a tie)."""
    return metrics.groupBy(*by).agg(
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
        F.min("f1").alias("f1_min"),
        F.max("f1").alias("f1_max"),
        F.min_by(run, F.struct(-F.col("f1"), F.col(run))).alias("best_run"),
    ).withColumn("stable", F.col("f1_std") <= limit)


def stage_latency(timings: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    return timings.groupBy(stage).agg(
        F.sum(ms).alias("total"), F.avg(ms).alias("avg"), F.min(ms).alias("min"),
        F.max(ms).alias("max"), F.count(ms).alias("count"),
    )


def latency_summary(timings: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """One row with the totals and means of the stages rf, gcn, fusion and total.

    Model time is rf plus gcn, averaged over the number of ``total`` rows (at least 1).
    """

    def of(name):
        return F.when(F.col(stage) == name, F.col(ms))

    zero = F.lit(0.0)
    raw = []
    for name in ("rf", "gcn", "fusion", "total"):
        raw += [
            F.coalesce(F.sum(of(name)), zero).alias(f"{name}_total_ms"),
            F.coalesce(F.avg(of(name)), zero).alias(f"{name}_avg_ms"),
        ]
    out = timings.agg(*raw, F.greatest(F.count(of("total")), F.lit(1)).alias("sample_count"))
    model = F.col("rf_total_ms") + F.col("gcn_total_ms")
    return out.withColumns(
        {"model_output_total_ms": model, "model_output_avg_ms": model / F.col("sample_count")}
    )


def best_per_category(metrics: DataFrame, baseline: str) -> DataFrame:
    """Best method per category, its gain over ``baseline`` in percent, overall best marked.

    Ties go to the smaller method name.
    """
    ties = metrics.groupBy("category", "f1").agg(F.min("method").alias("method"))
    best = ties.groupBy("category").agg(
        F.max("f1").alias("f1"), F.max_by("method", "f1").alias("method")
    )
    base = metrics.where(F.col("method") == baseline).agg(F.max("f1")).scalar()
    top = best.agg(F.min_by("method", F.struct(-F.col("f1"), F.col("method")))).scalar()
    return best.withColumn("_base", base).select(
        "category", "method", "f1",
        F.when(F.col("_base") != 0, (F.col("f1") - F.col("_base")) / F.col("_base") * 100.0)
        .alias("gain_percent"),
        (F.col("method") == top).alias("overall_best"),
    )


def split_overlap(train: DataFrame, val: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Ids shared by each pair of splits; a leak is an overlap with the test split.

    One grouped pass over the three id lists instead of three joins.
    """
    marked = reduce(
        DataFrame.unionByName,
        [
            part.select(key).withColumns({n: F.lit(n == name) for n in ("a", "b", "c")})
            for part, name in ((train, "a"), (val, "b"), (test, "c"))
        ],
    )
    per_id = marked.groupBy(key).agg(*[F.max(n).alias(n) for n in ("a", "b", "c")])

    def both(x, y, name):
        return F.count(F.when(F.col(x) & F.col(y), 1)).alias(name)

    return per_id.agg(
        both("a", "b", "train_val"), both("a", "c", "train_test"), both("b", "c", "val_test")
    ).withColumn("leak", (F.col("train_test") > 0) | (F.col("val_test") > 0))


def rank_desc(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """1-based rank by descending value. For metric and importance tables, whose size is
    set by a grid or a feature list and not by the data."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(value), F.asc(tie))))


def top_cells(metrics: DataFrame, n: int = 10, tie: str = "cell") -> DataFrame:
    return metrics.orderBy(F.desc("f1"), F.asc(tie)).limit(n)


def pick_best(metrics: DataFrame, rule: str = "max_f1", tie: str = "cell") -> DataFrame:
    """``max_f1``: highest f1 above 0. ``min_fnr``: lowest fnr, then highest f1.

    ``tie`` is the loop order; the first cell wins.
    """
    if rule == "max_f1":
        return metrics.where(F.col("f1") > 0).orderBy(F.desc("f1"), F.asc(tie)).limit(1)
    return metrics.orderBy(F.asc("fnr"), F.desc("f1"), F.asc(tie)).limit(1)
