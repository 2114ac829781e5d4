"""Fusion of the forest and graph probabilities, as Column expressions.

Each method returns a struct ``(prob, threshold, verdict, mode, weight_rf)``. Every
verdict is a strict ``>``. Parameters may be numbers or Columns, so one expression
serves single calls and parameter grids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Tuned parameters.
PRODUCTION = {
    "alpha": 0.4,
    "conf_threshold": 0.5,
    "weight_high_conf": 0.4,
    "weight_low_conf": 0.15,
    "threshold_adjust_rf": 0.1,
    "threshold_adjust_gcn": 0.05,
}
PRODUCTION_FIXED_ALPHA = 0.33
EXPERIMENT_FIXED_ALPHA = 0.32
BEST_CONFIDENCE = {
    "alpha": 0.2, "conf_threshold": 0.4, "weight_high_conf": 0.45, "weight_low_conf": 0.1,
}
BEST_THRESHOLD = {"alpha": 0.32, "threshold_adjust_rf": 0.05, "threshold_adjust_gcn": 0.03}
BEST_DUAL = {
    "alpha": 0.2, "conf_threshold": 0.4, "weight_high_conf": 0.5, "weight_low_conf": 0.1,
    "threshold_adjust_rf": 0.05, "threshold_adjust_gcn": 0.03,
}


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def confidence(p: Column) -> Column:
    return F.abs(p - F.lit(0.5)) * F.lit(2.0)


def hard(p: Column) -> Column:
    return (p > F.lit(0.5)).cast("int")


def weighted(rf: Column, gcn: Column, weight: Column) -> Column:
    return weight * rf + (F.lit(1.0) - weight) * gcn


def _result(rf, gcn, weight, threshold, mode) -> Column:
    prob = weighted(rf, gcn, weight)
    return F.struct(
        prob.alias("prob"),
        threshold.alias("threshold"),
        (prob > threshold).cast("int").alias("verdict"),
        mode.alias("mode"),
        weight.alias("weight_rf"),
    )


def fuse_adaptive(rf: Column, gcn: Column, **params) -> Column:
    """Production fusion: weight and threshold follow agreement and confidence."""
    p = {k: _col(v) for k, v in (PRODUCTION | params).items()}
    agree = hard(rf) == hard(gcn)
    rf_alone = hard(rf) > hard(gcn)
    rf_sure = confidence(rf) > p["conf_threshold"]
    gcn_sure = confidence(gcn) > p["conf_threshold"]
    weight = (
        F.when(agree, p["alpha"])
        .when(rf_alone & rf_sure, p["weight_high_conf"])
        .when(rf_alone, p["weight_low_conf"])
        .when(gcn_sure, F.lit(1.0) - p["weight_high_conf"])
        .otherwise(p["alpha"])
    )
    threshold = (
        F.when(agree, F.lit(0.5))
        .when(rf_alone, F.lit(0.5) + p["threshold_adjust_rf"] * (F.lit(1.0) - confidence(rf)))
        .otherwise(F.lit(0.5) - p["threshold_adjust_gcn"] * confidence(gcn))
    )
    mode = (
        F.when(agree, "consistent")
        .when(rf_alone & rf_sure, "rf_high_conf")
        .when(rf_alone, "rf_low_conf")
        .when(gcn_sure, "gcn_high_conf")
        .otherwise("gcn_low_conf")
    )
    return _result(rf, gcn, weight, threshold, mode)


def fuse_fixed(rf: Column, gcn: Column, alpha=PRODUCTION_FIXED_ALPHA) -> Column:
    return _result(rf, gcn, _col(alpha), F.lit(0.5), F.lit("fixed"))


def weight_choice(rf_confidence: Column, gcn_confidence: Column, conf_threshold) -> Column:
    """Which weight a disagreeing pair takes: 0 alpha, 1 the high one, 2 the low one."""
    limit = _col(conf_threshold)
    rf_sure, gcn_sure = rf_confidence > limit, gcn_confidence > limit
    return (
        F.when(rf_sure & (~gcn_sure | (rf_confidence > gcn_confidence)), 1)
        .when(gcn_sure, 2)
        .otherwise(0)
    )


def _confidence_weight(rf, gcn, alpha, conf_threshold, weight_high_conf, weight_low_conf):
    choice = weight_choice(confidence(rf), confidence(gcn), conf_threshold)
    return (
        F.when(hard(rf) == hard(gcn), _col(alpha))
        .when(choice == 1, _col(weight_high_conf))
        .when(choice == 2, _col(weight_low_conf))
        .otherwise(_col(alpha))
    )


def shifted_threshold(rf, gcn, threshold_adjust_rf, threshold_adjust_gcn) -> Column:
    moved = (
        F.when(hard(rf) == hard(gcn), F.lit(0.5))
        .when(hard(rf) > hard(gcn), F.lit(0.5) + _col(threshold_adjust_rf))
        .otherwise(F.lit(0.5) - _col(threshold_adjust_gcn))
    )
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), moved))


def fuse_confidence_weight(
    rf, gcn, alpha, conf_threshold, weight_high_conf, weight_low_conf
) -> Column:
    weight = _confidence_weight(
        rf, gcn, alpha, conf_threshold, weight_high_conf, weight_low_conf
    )
    return _result(rf, gcn, weight, F.lit(0.5), F.lit("confidence_weight"))


def fuse_adaptive_threshold(
    rf, gcn, alpha, threshold_adjust_rf, threshold_adjust_gcn
) -> Column:
    threshold = shifted_threshold(rf, gcn, threshold_adjust_rf, threshold_adjust_gcn)
    return _result(rf, gcn, _col(alpha), threshold, F.lit("adaptive_threshold"))


def fuse_dual(
    rf, gcn, alpha, conf_threshold, weight_high_conf, weight_low_conf,
    threshold_adjust_rf, threshold_adjust_gcn,
) -> Column:
    weight = _confidence_weight(
        rf, gcn, alpha, conf_threshold, weight_high_conf, weight_low_conf
    )
    threshold = shifted_threshold(rf, gcn, threshold_adjust_rf, threshold_adjust_gcn)
    return _result(rf, gcn, weight, threshold, F.lit("dual"))


METHODS = {
    "adaptive": fuse_adaptive,
    "fixed": fuse_fixed,
    "confidence_weight": fuse_confidence_weight,
    "adaptive_threshold": fuse_adaptive_threshold,
    "dual": fuse_dual,
}


def fuse(df: DataFrame, method="adaptive", rf="rf_prob", gcn="gcn_prob", **params) -> DataFrame:
    """Add a ``fusion`` struct by method name, or by a callable of (rf, gcn, **params)."""
    call = METHODS[method] if isinstance(method, str) else method
    return df.withColumn("fusion", call(F.col(rf), F.col(gcn), **params))


def fuse_with_fallback(df: DataFrame, mode: str = "adaptive", **params) -> DataFrame:
    """One-sided records keep their only probability; all others are fused.

    Needs ``rf_prob``, ``gcn_prob``, ``has_features``, ``has_graph``.
    """
    rf, gcn = F.col("rf_prob"), F.col("gcn_prob")

    def single(prob, name, weight):
        return F.struct(
            prob.alias("prob"),
            F.lit(0.5).alias("threshold"),
            hard(prob).alias("verdict"),
            F.lit(name).alias("mode"),
            F.lit(weight).alias("weight_rf"),
        )

    both = METHODS[mode](rf, gcn, **params) if isinstance(mode, str) else mode(rf, gcn, **params)
    fusion = (
        F.when(~F.col("has_features") & F.col("has_graph"), single(gcn, "gcn_only", 0.0))
        .when(F.col("has_features") & ~F.col("has_graph"), single(rf, "rf_only", 1.0))
        .otherwise(both)
    )
    return df.withColumn("_fusion", fusion).select(
        *df.columns,
        F.col("_fusion.prob").alias("final_prob"),
        F.col("_fusion.verdict").alias("is_anomaly"),
        F.col("_fusion.mode").alias("mode"),
        F.col("_fusion.threshold").alias("threshold"),
        F.col("_fusion.weight_rf").alias("weight_rf"),
    )


def gate_inputs(rf: Column, gcn: Column, width: int = 6) -> Column:
    values = [rf, gcn, confidence(rf), confidence(gcn), rf * gcn, F.abs(rf - gcn)]
    return F.array(*values[:width])
