"""Checks, defaults and small conversions on feature records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CALL_GRAPH, CATEGORICAL, MESSAGE_FEATURES, NUMERIC, SOURCE_IP_NAMES, c

_INF = float("inf")


def _is_infinite(col: Column) -> Column:
    return (col == F.lit(_INF)) | (col == F.lit(-_INF))


def feature_error(columns: list[str]) -> Column:
    """First problem of a record in feature order, NULL if there is none."""
    checks = []
    for name in NUMERIC:
        if name not in columns:
            checks.append(F.lit(f"missing numeric feature: {name}"))
            continue
        col = c(name)
        checks.append(
            F.when(col.isNull(), f"feature {name} is NULL")
            .when(F.isnan(col), f"feature {name} is NaN")
            .when(_is_infinite(col), f"feature {name} is Inf")
        )
    for name in CATEGORICAL:
        if name not in columns:
            checks.append(F.lit(f"missing category: {name}"))
        else:
            checks.append(F.when(c(name).isNull(), f"category {name} is not valid"))
    return F.coalesce(*checks)


def validate_features(df: DataFrame) -> DataFrame:
    return df.withColumn("error", feature_error(df.columns)).withColumn(
        "is_valid", F.col("error").isNull()
    )


def default_missing(df: DataFrame) -> DataFrame:
    """Add absent feature columns: 0.0 for numbers, ``unknown`` for categories."""
    new = {n: F.lit(0.0) for n in NUMERIC if n not in df.columns}
    new |= {n: F.lit("unknown") for n in CATEGORICAL if n not in df.columns}
    return df.withColumns(new)


def fill_missing(df: DataFrame) -> DataFrame:
    """Training form: NULL and NaN numbers to 0, NULL categories to ``unknown``."""
    df = default_missing(df)
    new = {n: F.coalesce(F.nanvl(c(n), F.lit(0.0)), F.lit(0.0)) for n in NUMERIC}
    new |= {n: F.coalesce(c(n), F.lit("unknown")) for n in CATEGORICAL}
    return df.withColumns(new)


def clean_features(df: DataFrame) -> DataFrame:
    """NULL, NaN and Inf numbers to 0.0; NULL categories to ``unknown``."""
    df = default_missing(df)
    new = {}
    for n in NUMERIC:
        col = c(n).cast("double")
        new[n] = F.when(col.isNull() | F.isnan(col) | _is_infinite(col), 0.0).otherwise(col)
    for n in CATEGORICAL:
        new[n] = F.coalesce(c(n).cast("string"), F.lit("unknown"))
    return df.withColumns(new)


def label(classification: Column) -> Column:
    return F.coalesce((classification == "outlier").cast("int"), F.lit(0))


def source_ip(df: DataFrame) -> Column:
    """The first of the known source columns that the table has, else ''."""
    for name in SOURCE_IP_NAMES:
        if name in df.columns:
            return F.coalesce(c(name).cast("string"), F.lit(""))
    return F.lit("")


def task_trace_id(kind: str, task: Column | int, record: Column) -> Column:
    task = task if isinstance(task, Column) else F.lit(task)
    return F.concat_ws("-", F.lit(kind), task.cast("string"), record)


def features_to_json(columns: list[str]) -> Column:
    """All feature columns of a record as one JSON object; NULL if it has none."""
    if not columns:
        return F.lit(None).cast("string")
    return F.to_json(F.struct(*[c(n) for n in columns]), {"ignoreNullFields": "false"})


def graph_to_json(call_graph: Column) -> Column:
    return F.when(F.size(call_graph) > 0, F.to_json(call_graph))


def features_from_json(text: Column) -> Column:
    return F.from_json(text, MESSAGE_FEATURES)


def graph_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, CALL_GRAPH), F.array().cast(CALL_GRAPH))
